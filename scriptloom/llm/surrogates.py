"""Personal data replaced by keyed surrogates, in DataFrame operations only.

Entities are found by regular expressions: mail addresses, phone numbers, internet
addresses, account and card numbers, social-security and bank-account numbers, and names
that follow an honorific or a phrase such as "my name is", or start with a listed given
name; with initials, particles, hyphens, apostrophes and inner or all capitals.  Where a text
has a name, its words alone ("Smith", "John") are mentions too, wherever they stand in that
text.  Each is replaced by a value of the same type and shape:

* Letters and digits go through a keyed cipher, character by character, in which each
  depends on all others: once forward and once backward, by a chain of SHA-256 digests that
  starts from the key.  A letter stays in its script, its case and its class (vowel or
  consonant where the script has them), a digit a digit, and everything else stays as it is;
  so do country codes, top-level domains and particles.
* Internet addresses of 32 bits are permuted as numbers, longer ones digit by digit, so they
  stay valid.
* The last digit of a card or account number keeps the remainder of its Luhn sum.
* Listed given names are exchanged within their gender and script along a cycle in an order
  that the key gives, so one known pair tells nothing of the others; honorifics stay.

All of these are permutations of the values of one shape.  So different values get
different surrogates, however many there are, and equal ones get equal surrogates in every
document, without a table of entities to join.  Case and punctuation aren't part of a
value: "Ann@x.org" and "ann@X.org", or two spellings of a number, stay together.
``collisions`` checks that over a whole corpus and ``replace_entities(check=True)``, which
does so at once when it is called, fails rather than returning texts in which two people
have become one.

Narrow but for that check, which aggregates entities only, by surrogate, with partial
sums.  Null texts stay null with no entities; empty ones stay empty; very long texts are
replaced whole.  Repeated rows are replaced alike; an empty table gives no rows.  A column
``entities`` is replaced; all others stay, whatever their names.  Letters of scripts that have neither a class nor a
range below stay.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

# Given names by gender and script, exchanged within each list.
GIVEN = {
    ("f", "latin"): "Aisha Alice Amina Anna Barbara Carmen Charlotte Claire Elena Emily Emma Fatima Greta Hannah Ingrid Isabel Jennifer Jessica Julia Karen Katarzyna Lakshmi Laura Leila Linda Lucia Maria Marie Mary Mei Nadia Nicole Olivia Patricia Paula Priya Rosa Sarah Sofia Sophie Susan Ursula Yuki Zainab".split(),
    ("m", "latin"): "Ahmed Albert Ali Antonio Arjun Carlos Charles Daniel David Diego Felix Frank George Giovanni Hans Hassan Henry Hiroshi Hugo Ivan Jacques James Jean John Jorge Jose Joseph Karl Kenji Luis Marco Michael Mohammed Omar Otto Pablo Paul Peter Pierre Rahul Richard Robert Takeshi Thomas Wei William Yusuf".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга Софья Татьяна".split(),
    ("m", "cyrillic"): "Алексей Борис Виктор Дмитрий Иван Михаил Николай Олег Павел Сергей".split(),
}
# Words before a name, inside one, and phrases that a name follows.
HONORIFICS = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Señor Señora Sr Sra".split()
PARTICLES = "van von der den de del della di da dos du la le bin ibn al ter ten zu zur zum".split()
# Words of English, German, French and Spanish that open sentences, and so stand behind
# names with a capital without being part of them.
COMMON = (
    "A About After All Also Am An And Are As At Be Because Before But By Can Could Did Do Does For From Had Has Have He Her Here His How I If In Is It Its May Might Must My No Not Now Of Oh On "
    "Or Our Please Shall She Should So Some That The Their Then There These They This Those To Was We Were What When Where Which While Who Why Will With Would Yes You Your "
    "Aber Als Am Auch Auf Aus Bei Bis Da Dann Das Der Die Dies Doch Ein Eine Er Es Für Hat Hier Ich Ihr Im Ist Ja Kann Mit Nach Nein Nicht Noch Nun Oder Sie Sind Und Von Vor War Warum Was Wenn Wer Wie Wir Wird Wo Zu "
    "Alors Après Au Aussi Avec Ce Ces Cette Comme Dans Donc Elle En Est Et Il Ils Je La Le Les Mais Ne Nous Non On Ou Où Oui Par Pas Pour Quand Que Qui Sans Si Son Sur Très Un Une Vous "
    "Además Ahora Aquí Así Con Cuando De Después Ella Ellos Entonces Era Eso Esta Este Hay La Las Los Muy Nada No Nosotros Para Pero Por Porque Que Quien Se Ser Sin Sobre Son Su También Todo Tras Un Una Usted Ya Yo"
).split()
#: A word behind an article is a thing, not a person.
DETERMINED = r"(?<!\p{L})(?<![Vv][ao]n )(?<![Dd]e )(?:[Tt]he|[Aa]n?|[Dd](?:as|er|ie|em|en|es)|[Ee]ine?[nmrs]?|[Ll][ea]s?|[Uu]ne?|[Ee]l|[Ll]os|[Uu]nas?) (\p{Lu}[\p{L}\p{M}]*+)"
CUES = ("[Mm]y name is ", "[Nn]ame: ", "[Ss]igned by ", "[Dd]ear ", "[Ii]ch heiße ", "[Mm]e llamo ", "[Jj]e m'appelle ")


def _listed(words: list[str]) -> str:
    """Any of the words, as written or in capitals; by first letters, so that most texts fail at once."""
    by = {}
    for w in words:
        for form in dict.fromkeys((w, w.upper())):
            by.setdefault(form[0], []).append(form[1:])
    return "(?:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in sorted(by.items())) + ")"


_EDGE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
#: A word of a name: hyphens and apostrophes inside, but no possessive ending.
_NAME = r"\p{Lu}[\p{L}\p{M}]*+(?:['’-](?!s(?!\p{L}))[\p{L}\p{M}]++)*+"
_INITIAL = r"\p{Lu}\."
_PARTICLE = "(?:" + "|".join(PARTICLES) + ")"
_MORE = rf"(?: {_INITIAL}| (?:{_PARTICLE} ){{0,3}}{_NAME})"
_FIRST = rf"(?:{_INITIAL} ?){{0,3}}(?:{_PARTICLE} ){{0,3}}{_NAME}"
_SIX = r"[0-9A-Fa-f]{1,4}"
PATTERNS = {
    "mail": r"(?<![\p{L}\p{N}_%+-])[\p{L}\p{N}_%+-]++(?:\.[\p{L}\p{N}_%+-]++)*+@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "bank": _EDGE + r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?" + _END,
    "phone": r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|[2-9][0-9]{2}[2-9][0-9]{6})" + _END,
    "ip": r"(?<![\p{L}\p{N}.])(?<![Vv]ersion )(?<![Rr]elease )(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![\p{L}\p{N}]|\.[0-9])",
    "ip6": rf"(?<![\p{{L}}\p{{N}}:.])(?=[A-Fa-f:]*[0-9])(?:{_SIX}(?::{_SIX}){{7}}|(?:{_SIX}(?::{_SIX}){{0,5}})?::(?:{_SIX}(?::{_SIX}){{0,5}})?)(?![\p{{L}}\p{{N}}:])",
    "social": _EDGE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _END,
    "account": _EDGE + r"[0-9](?:[ -]?[0-9]){12,18}" + _END,
    "name": rf"(?<!\p{{L}})(?=\p{{Lu}})(?:{_listed(HONORIFICS)}\.? {_FIRST}|{_listed([n for names in GIVEN.values() for n in names])}{_MORE}|(?<={'|'.join(CUES)}){_FIRST}){_MORE}{{0,3}}" + _END,
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every entity has; texts without it are passed by quickly.
_HINT = rf"@|[0-9][ .-]?[0-9]|\+[0-9]|:[0-9A-Fa-f]{{0,4}}:|\p{{Lu}}[\p{{L}}\p{{M}}'’-]*\.? (?:\p{{Lu}}|{_PARTICLE} )|" + "|".join(f"{c}" + r"\p{L}" for c in CUES)

#: Letters that are exchanged with each other, lower case: of one script and one class.
CLASSES = (
    "0123456789",
    "aeiou",
    "bcdfghjklmnpqrstvwxyz",
    "àâäáãåèéêëìíîïòóôöõùúûü",
    "çñýšžčř",
    "аеёиоуыэюя",
    "бвгджзйклмнпрстфхцчшщъь",
    "αεηιουω",
    "βγδζθκλμνξπρστφχψ",
    "".join(c for c in map(chr, range(0x100, 0x180)) if c.islower() and c.upper().lower() == c and c not in "žšřč"),
)
#: First and last letter of scripts without case, whose letters are exchanged with each other.
RANGES = ((0x5D0, 0x5EA), (0x621, 0x63A), (0x641, 0x64A), (0x904, 0x939), (0xE01, 0xE2E), (0x10D0, 0x10F0), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))
#: Digits of long internet addresses.
HEX = ("0123456789abcdef",)
#: Times that a surname goes through the cipher at most, while it comes out as a listed given name.
ROUNDS = 8


def kind_of(value: Column) -> Column:
    """The type of an entity that ENTITY has found; the first pattern's that fits it whole."""
    kinds = reduce(lambda out, k: out.when(value.rlike(rf"\A(?:{PATTERNS[k]})\z"), k), list(PATTERNS)[1:], F.when(F.contains(value, F.lit("@")), "mail"))
    return kinds.otherwise("name")


def _characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """What ``then`` makes of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), then)[0]


def _moved(digest: Column, char: Column, hexadecimal: Column) -> Column:
    """A character's counterpart in its class, as many places on as the digest says."""
    h = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")
    by_class = lambda make: F.when(hexadecimal, F.lit(make(HEX))).otherwise(F.lit(make(CLASSES)))
    letters = by_class("".join)
    # Start and size of each letter's class, in three digits each.
    spans = by_class(lambda classes: "".join(f"{sum(map(len, classes[:k])):03d}{len(c):03d}" * len(c) for k, c in enumerate(classes)))

    def placed(place: Column) -> Column:
        start, size = (F.substring(spans, (place - 1) * 6 + i, F.lit(3)).cast("int") for i in (1, 4))
        moved = F.substring(letters, start + F.pmod(place - 1 - start + h, size).cast("int") + 1, F.lit(1))
        return F.when(place > 0, F.when(char == F.lower(char), moved).otherwise(F.upper(moved))).otherwise(F.coalesce(F.get(other, 0), char))

    point = F.ascii(char).cast("long")
    scripts = F.array(*(F.struct(F.lit(a).cast("long").alias("first"), F.lit(b).cast("long").alias("last")) for a, b in RANGES))
    turned = lambda s: F.pmod(point - s["first"] + h, s["last"] - s["first"] + 1) + s["first"]
    other = F.transform(F.filter(scripts, lambda s: point.between(s["first"], s["last"])), lambda s: F.decode(F.unhex(F.lpad(F.hex(turned(s)), 4, "0")), "UTF-16BE"))
    return _bound(F.instr(letters, F.lower(char)), placed)


def _pass(text: Column, key: Column, hexadecimal: Column) -> Column:
    """The cipher from left to right: each letter moves by a digest of the key and all before it."""
    start = F.struct(key.alias("h"), F.lit("").alias("out"))

    def step(acc: Column, char: Column) -> Column:
        h = F.when(char.rlike(r"[\p{L}\p{N}]"), F.sha2(F.concat(acc["h"], F.lower(char)), 256)).otherwise(acc["h"])
        return F.struct(h.alias("h"), F.concat(acc["out"], _moved(acc["h"], char, hexadecimal)).alias("out"))

    return F.aggregate(_characters(text), start, step, lambda acc: acc["out"])


def cipher(text: Column, key: str, label: str | Column, hexadecimal: bool | Column = False) -> Column:
    """A keyed permutation of the texts of one shape: there and back, by two keys."""
    label, hexadecimal = (F.lit(x) if not isinstance(x, Column) else x for x in (label, hexadecimal))
    keys = F.array(*(F.sha2(F.concat(F.lit(f"{key}|"), label, F.lit(f"|{i}")), 256) for i in (1, 2)))
    return F.aggregate(keys, text, lambda out, own: F.reverse(_pass(out, own, hexadecimal)))


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a string of digits."""
    steps = F.transform(_characters(F.reverse(digits)), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(steps, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)), lambda a: a % 10)


def _address(value: Column, key: str) -> Column:
    """A Feistel permutation of the 32 bits, four rounds over two halves of 16."""
    octets = F.split(value, r"\.")
    halves = F.struct(*((octets[i].cast("bigint") * 256 + octets[i + 1].cast("bigint")).alias(side) for i, side in ((0, "left"), (2, "right"))))
    keys = F.array(*(F.sha2(F.lit(f"{key}|ip|{i}"), 256) for i in range(4)))

    def turn(acc: Column, own: Column) -> Column:
        mix = F.conv(F.substring(F.sha2(F.concat(own, acc["right"].cast("string")), 256), 1, 4), 16, 10).cast("bigint")
        return F.struct(acc["right"].alias("left"), F.pmod(acc["left"] + mix, F.lit(65536)).alias("right"))

    byte = lambda acc: (x.cast("string") for side in ("left", "right") for x in (F.floor(acc[side] / 256), F.pmod(acc[side], F.lit(256))))
    return F.aggregate(keys, halves, turn, lambda acc: F.concat_ws(".", *byte(acc)))


def exchanged(key: str) -> dict[str, str]:
    """Each listed given name's counterpart: the next in its list, in an order that the key gives."""
    import hashlib

    out = {}
    for names in GIVEN.values():
        order = sorted(names, key=lambda n: hashlib.sha256(f"{key}|given|{n}".encode()).digest())
        out.update(zip(order, [*order[1:], order[0]], strict=True))
    return out


def _word(kind: Column, word: Column, key: str) -> Column:
    """A part of an entity through the cipher; a name's words go by lists first.

    A surname whose surrogate is a listed given name goes through again, so that none is met
    by two."""
    named, listed = kind == "name", F.create_map(*(F.lit(x) for pair in exchanged(key).items() for x in pair))
    titles = [f for h in HONORIFICS for f in (h, h.upper())]
    stays = word.rlike(r"\A(?:" + "|".join(titles) + r")\.?\z") | word.isin(PARTICLES)
    given = lambda w: F.initcap(F.lower(w))
    again = lambda out, i: (i == 1) | (named & given(out).isin([n for names in GIVEN.values() for n in names]))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), word, lambda out, i: F.when(again(out, i), cipher(out, key, kind, kind == "ip6")).otherwise(out))
    own = lambda g: F.when(g.isNotNull(), F.when(word == F.upper(word), F.upper(g)).otherwise(g)).otherwise(walked)
    return F.when(named & stays, word).otherwise(_bound(F.when(named, listed[given(word)]), own))


def surrogate(kind: Column, value: Column, key: str) -> Column:
    """One cipher for all kinds, as the plan of a cipher for each is a load on the driver.

    Names go word by word, so that a surname alone and with a given name stay together; a
    top-level domain, a plus sign and a country's sign or first digits stay, however they are
    set off; an account's last digit is set for the same Luhn remainder."""
    country = F.regexp_extract(value, r"\A\+(?:[17]|[0-9]{2})", 0)
    head = F.when(kind == "phone", country).when(kind == "bank", F.substring(value, 1, 2)).otherwise("")
    tail = F.when(kind == "mail", F.regexp_extract(value, r"\.[^.]*\z", 0)).when(kind == "account", F.substring(value, -1, 1)).otherwise("")
    body = F.substring(value, F.length(head) + 1, F.length(value) - F.length(head) - F.length(tail))
    parts = F.when(kind == "name", F.split(value, " ")).otherwise(F.array(body))
    front = F.concat(head, F.array_join(F.transform(parts, lambda w: _word(kind, w, key)), " "))
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    last = lambda c: F.pmod(_luhn(digits(value)) - _luhn(F.concat(digits(c), F.lit("0"))), F.lit(10)).cast("string")
    return F.when(kind == "ip", _address(value, key)).otherwise(_bound(front, lambda c: F.concat(c, F.when(kind == "account", last(c)).otherwise(tail))))


def _identity(kind: Column, value: Column) -> Column:
    """What makes two mentions the same: no case, no punctuation outside addresses."""
    low = F.lower(value)
    return F.when(kind.isin("mail", "ip", "ip6", "name"), low).otherwise(F.regexp_replace(low, r"[^\p{L}\p{N}]", ""))


def _found(text: Column) -> Column:
    return F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)))


def _names(found: Column) -> Column:
    return F.filter(found, lambda v: v.rlike(r"\A\p{Lu}\p{L}*+[.'’ -]") & (kind_of(v) == "name"))


def _plain_words(found: Column, text: Column) -> Column:
    """Words of the names among the mentions that the text also has as no name: in small letters,
    behind an article, or such as open sentences."""
    words = F.array_distinct(F.flatten(F.transform(_names(found), lambda v: F.split(v, " "))))
    determined = F.regexp_extract_all(text, F.lit(DETERMINED), F.lit(1))
    small = lambda w: (w != F.lower(w)) & F.contains(text, F.concat(F.lit(" "), F.lower(w), F.lit(" ")))
    return _bound(determined, lambda d: F.filter(words, lambda w: w.isin(COMMON) | F.array_contains(d, w) | small(w)))


def _trimmed(value: Column, plain: Column) -> Column:
    """A name without plain words at its end.  What follows an honorific, a given name, an
    initial or a particle is always part of it."""
    needs = lambda w: w.rlike(r"\A\p{Lu}\.\z") | w.isin(PARTICLES)

    def cut(words: Column) -> Column:
        step = lambda n, i: F.when((n == i) & F.array_contains(plain, words[i - 1]) & ~needs(words[i - 2]), i - 1).otherwise(n)
        size = F.aggregate(F.sequence(F.size(words), F.lit(3), F.lit(-1)), F.size(words), step)
        return F.when(F.size(words) > 2, F.array_join(F.slice(words, F.lit(1), size), " ")).otherwise(value)

    named = F.size(F.filter(plain, lambda w: F.endswith(value, F.concat(F.lit(" "), w)))) > 0
    return F.when(named, _bound(F.split(value, " "), cut)).otherwise(value)


def _words_of(found: Column, plain: Column) -> Column:
    """Words of the names among the mentions that stand for a person alone, longest first; as
    written and in capitals."""
    titles = [f for h in HONORIFICS for f in (h, h.upper())]
    words = F.flatten(F.transform(_names(found), lambda v: F.split(v, " ")))
    own = F.filter(words, lambda w: w.rlike(r"\A\p{Lu}[\p{L}\p{M}'’-]+\z") & ~w.isin(titles) & ~F.array_contains(plain, w))
    every = F.array_distinct(F.concat(own, F.transform(own, lambda w: F.upper(w))))
    return F.transform(F.reverse(F.array_sort(F.transform(every, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))), lambda x: x["w"])


def _marked(docs: DataFrame, text: str) -> tuple[DataFrame, str, str, str]:
    """Adds the mentions as they stand, the expression for them where the text has names (with
    their words alone), and its plain words; and the names of these columns."""
    body, none = F.col(text), F.array().cast("array<string>")
    m, p, x, w = unused(docs.columns, "__m", "__p", "__x", "__w")
    first = docs.withColumn(m, F.coalesce(_found(body), none)).withColumn(x, F.when(F.size(m) > 0, _plain_words(F.col(m), body)).otherwise(none))
    first = first.withColumn(w, F.when(F.size(m) > 0, _words_of(F.transform(m, lambda v: _trimmed(v, F.col(x))), F.col(x))))
    alone = F.concat(F.lit(rf"{ENTITY}|(?<!\p{{L}})(?:\Q"), F.array_join(w, r"\E|\Q"), F.lit(r"\E)(?!\p{L})"))
    named = first.withColumn(p, F.when(F.size(w) > 0, alone))
    return named.withColumn(m, F.when(F.col(p).isNull(), F.col(m)).otherwise(F.regexp_extract_all(body, F.col(p), F.lit(0)))).drop(w), m, p, x


def entities(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Every distinct mention: kind, value, surrogate."""
    marked, m, _, x = _marked(docs.select(text), text)
    own = F.array_distinct(F.transform(m, lambda v: _trimmed(v, F.col(x))))
    values = marked.select(F.explode(own).alias("value")).groupBy("value").agg(F.count("*").alias("documents"))
    return values.withColumn("kind", kind_of(F.col("value"))).withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), key))


def collisions(found: DataFrame) -> DataFrame:
    """Surrogates that stand for different values: there should be none."""
    kind = F.col("kind")
    each = found.select("kind", _identity(kind, F.col("surrogate")).alias("surrogate"), _identity(kind, F.col("value")).alias("value"))
    return each.groupBy("kind", "surrogate").agg(F.min("value").alias("one"), F.max("value").alias("other")).where("one <> other")


def replace_entities(docs: DataFrame, key: str, text: str = "text", check: bool = True) -> DataFrame:
    """The documents with their entities replaced in ``text``, and the array ``entities`` of
    (kind, value, surrogate) in order.  With ``check``, one pass more over the corpus's
    entities makes sure first that surrogates are distinct."""
    if check:
        clash = collisions(entities(docs, key, text)).limit(1).collect()
        if clash:
            raise ValueError(f"two values have one surrogate: {clash[0].asDict()}")
    body = F.col(text)
    marked, m, p, x = _marked(docs.drop("entities"), text)
    kinds = F.transform(F.transform(m, lambda v: _trimmed(v, F.col(x))), lambda v: F.struct(v.alias("value"), kind_of(v).alias("kind")))
    full = F.transform(kinds, lambda e: F.struct(e["kind"].alias("kind"), e["value"].alias("value"), surrogate(e["kind"], e["value"], key).alias("surrogate")))
    out = marked.withColumn("entities", F.when(F.size(m) > 0, full).otherwise(F.array().cast("array<struct<kind:string,value:string,surrogate:string>>")))
    gaps = F.when(F.col(p).isNull(), F.split(body, ENTITY, -1)).otherwise(F.split(body, F.col(p), -1))
    # What is trimmed off a mention stands behind its surrogate, before the next gap.
    rests = F.zip_with(F.col(m), F.col("entities"), lambda v, e: F.struct(e["surrogate"].alias("s"), F.substring(v, F.length(e["value"]) + 1, F.length(v)).alias("rest")))
    turns = F.zip_with(gaps, rests, lambda gap, e: F.concat(gap, F.coalesce(e["s"], F.lit("")), F.coalesce(e["rest"], F.lit(""))))
    return out.withColumn(text, F.when(F.size(m) > 0, F.array_join(turns, "")).otherwise(body)).drop(m, p, x)


def surrogate_documents(documents: DataFrame, key: str) -> DataFrame:
    """Identifier, replaced text, and the number of entities of each kind."""
    out = replace_entities(documents.select("doc_id", "text"), key)
    count = lambda k: F.size(F.filter("entities", lambda e: e["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), *(count(k) for k in PATTERNS))
