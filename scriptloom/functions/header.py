"""Header parts as columns: validated values, builders, look-ups.

A validator gives a struct of ``value`` and ``error``.  Builders take valid values.  Optional
text is trimmed and null where blank, so setting a blank text clears it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import errors
from .text import checked, field, has_space, optional, required, trim

FILE = "struct<title:string,series:string,synopsis:string>"
PROFILE = "struct<synopsis:string,speaker:array<string>,lang:array<string>>"
SYSTEM = "struct<id:string,desc:string>"
ENCODING = f"struct<annotationSystem:array<{SYSTEM}>>"
CHANGE = "struct<description:string,resp:string>"
REVISION = f"struct<change:array<{CHANGE}>>"
HEADER = f"struct<fileDesc:{FILE},profileDesc:{PROFILE},encodingDesc:{ENCODING},revisionDesc:{REVISION}>"


def document_title(text: Column) -> Column:
    return required(text, errors.TITLE)


def speaker_name(text: Column) -> Column:
    return field(text, errors.SPEAKER_NAME)


def language_tag(text: Column) -> Column:
    return field(text, errors.LANGUAGE)


def annotation_system_id(text: Column) -> Column:
    return field(text, errors.SYSTEM)


def responsible_party(text: Column) -> Column:
    return field(text, errors.RESPONSIBLE)


def annotation_system(identifier: Column, description: Column) -> Column:
    own = annotation_system_id(identifier)
    return checked(F.struct(own["value"].alias("id"), optional(description).alias("desc")), own["error"])


def revision_change(description: Column, resp: Column) -> Column:
    """A blank ``resp`` counts as none."""
    own = field(description, errors.REVISION)
    return checked(F.struct(own["value"].alias("description"), optional(resp).alias("resp")), own["error"])


def xml_id(text: Column, container: str | None = None) -> Column:
    """An identifier; messages name the container if one is given."""
    empty, space = (errors.ID_EMPTY, errors.ID_SPACE) if container is None else (errors.CONTAINER_ID_EMPTY.format(container), errors.CONTAINER_ID_SPACE.format(container))
    value = trim(text)
    return checked(value, F.when(F.coalesce(value, F.lit("")) == "", F.lit(empty)).when(has_space(value), F.lit(space)))


def speaker(text: Column) -> Column:
    return required(text, errors.SPEAKER)


def optional_speaker(text: Column) -> Column:
    """Null stays null; a blank text is an error."""
    return checked(optional(text), F.when(text.isNotNull() & optional(text).isNull(), F.lit(errors.SPEAKER)))


def file_desc(title: Column, series: Column | None = None, synopsis: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(title.alias("title"), (none if series is None else optional(series)).alias("series"), (none if synopsis is None else optional(synopsis)).alias("synopsis"))


def with_text(part: Column, name: str, text: Column) -> Column:
    """The struct with an optional text set anew (series, synopsis)."""
    return part.withField(name, optional(text))


def profile_desc(synopsis: Column | None = None, speakers: Column | None = None, languages: Column | None = None) -> Column:
    """Lists take valid values; repeated ones stay, in order."""
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    return F.struct((none if synopsis is None else optional(synopsis)).alias("synopsis"), F.coalesce(empty if speakers is None else speakers, empty).alias("speaker"), F.coalesce(empty if languages is None else languages, empty).alias("lang"))


def _added(part: Column, name: str, own: Column) -> Column:
    """The struct with one more value in its list, unless the value is rejected."""
    grown = part.withField(name, F.array_append(part[name], own["value"]))
    return F.struct(F.when(own["error"].isNull(), grown).otherwise(part).alias("value"), own["error"].alias("error"))


def add_speaker(profile: Column, text: Column) -> Column:
    return _added(profile, "speaker", speaker_name(text))


def add_language(profile: Column, text: Column) -> Column:
    return _added(profile, "lang", language_tag(text))


def count_speakers(profile: Column) -> Column:
    return F.size(profile["speaker"]).cast("bigint")


def count_languages(profile: Column) -> Column:
    return F.size(profile["lang"]).cast("bigint")


def profile_is_empty(profile: Column) -> Column:
    return profile["synopsis"].isNull() & (F.size(profile["speaker"]) == 0) & (F.size(profile["lang"]) == 0)


def encoding_desc(systems: Column | None = None) -> Column:
    empty = F.array().cast(f"array<{SYSTEM}>")
    return F.struct((empty if systems is None else F.coalesce(systems.cast(f"array<{SYSTEM}>"), empty)).alias("annotationSystem"))


def add_annotation_system(encoding: Column, system: Column) -> Column:
    """Appends what ``annotation_system`` has checked; identifiers may repeat.  A rejected
    system appends nothing: the old value, with the error."""
    return _added(encoding, "annotationSystem", system.cast(f"struct<value:{SYSTEM},error:string>"))


def encoding_is_empty(encoding: Column) -> Column:
    return F.size(encoding["annotationSystem"]) == 0


def find_annotation_system(encoding: Column, identifier: Column) -> Column:
    """The first system with exactly this identifier, else null."""
    return F.try_element_at(F.filter(encoding["annotationSystem"], lambda s: s["id"] == identifier), F.lit(1))


def revision_desc(changes: Column | None = None) -> Column:
    empty = F.array().cast(f"array<{CHANGE}>")
    return F.struct((empty if changes is None else F.coalesce(changes.cast(f"array<{CHANGE}>"), empty)).alias("change"))


def add_change(revision: Column, change: Column) -> Column:
    """Appends what ``revision_change`` has checked, or nothing: the old value, with the error."""
    return _added(revision, "change", change.cast(f"struct<value:{CHANGE},error:string>"))


def revision_is_empty(revision: Column) -> Column:
    return F.size(revision["change"]) == 0


def header(file: Column, profile: Column | None = None, encoding: Column | None = None, revision: Column | None = None) -> Column:
    """A section that is given is present, even if it is empty."""
    parts = {"fileDesc": (file, FILE), "profileDesc": (profile, PROFILE), "encodingDesc": (encoding, ENCODING), "revisionDesc": (revision, REVISION)}
    return F.struct(*((F.lit(None) if c is None else c).cast(t).alias(n) for n, (c, t) in parts.items()))


def with_section(head: Column, name: str, section: Column) -> Column:
    """The header with a section (profileDesc, encodingDesc, revisionDesc) set; the last wins."""
    return head.withField(name, section)


def assembled(file: Column, profile: Column, encoding: Column, revision: Column) -> Column:
    """A header with those sections only that aren't empty."""
    return header(file, F.when(~profile_is_empty(profile), profile), F.when(~encoding_is_empty(encoding), encoding), F.when(~revision_is_empty(revision), revision))
