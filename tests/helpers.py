"""What tests expect of a checked value."""


def expect_value(checked, what="value"):
    """The value of a struct of value and error; fails with the error."""
    assert checked.error is None, f"{what}: {checked.error}"
    return checked.value


def expect_markup(checked):
    return expect_value(checked, "markup")
