"""Surrogates for personal data, with DataFrame functions only.

One regular expression finds the mentions; a mention is replaced by a keyed surrogate of its own kind, script and format. The
characters of a mention, each within its own alphabet, go through a keyed Feistel permutation (alternating halves, ``ROUNDS`` rounds): it is
one-to-one for every shape, so different entities keep different surrogates and the same entity gets
the same one everywhere, without a table of entities and without a shuffle. Case and punctuation are put back from the mention, so
``A.Smith@x.org`` and ``a.smith@x.org`` stay one person.

* e-mail: local part and domain are permuted apart, the top-level domain stays.
* card: all but the last digit are permuted, the last keeps its distance from the Luhn check digit, so valid stays valid.
* IPv4: four octets, each 0 to 255. Telephone: the country code stays. IBAN: the country stays.
* names: known first names move within the list of their gender and script, other name words keep
  script, case, vowels and consonants; titles stay.

Collision check: a surrogate must be neither an entity that the corpus really holds nor the surrogate of another one. Those that are
(``collisions``) get another one from a permutation of its own each round, checked against all real entities and all surrogates
given so far, until none is left; the rest of the table is not touched.
"""

from __future__ import annotations

import functools
import hashlib
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbweave.llm.common import let, written

ROUNDS = 6
WALKS = 16  # rounds within the shape of a mention; after them its surrogate grows
LISTED_WALKS = 2  # rounds in which a listed name moves within its list, which may be full of real names

_DIGITS = "0123456789"
_HEX = "0123456789abcdef"
_LATIN = "abcdefghijklmnopqrstuvwxyz"
_CYRILLIC = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
_GREEK = "αβγδεζηθικλμνξοπρστυφχψω"


def _cased(low: int, high: int, without: str = "") -> str:
    """The small letters of a block that have one capital, from which they come back."""
    letters = map(chr, range(low, high + 1))
    return "".join(c for c in letters if c.islower() and len(c.upper()) == 1 and c.upper() != c and c.upper().lower() == c and c not in without)


_WESTERN = _cased(0xE0, 0xFF)
#: Latin Extended-A, Extended-B, Greek and Cyrillic beyond their basic letters, Armenian, Georgian, Latin Extended Additional, Greek Extended, Coptic.
_MORE = tuple(
    _cased(low, high, _GREEK + _CYRILLIC)
    for low, high in ((0x100, 0x17F), (0x180, 0x24F), (0x370, 0x3FF), (0x400, 0x52F), (0x561, 0x587), (0x10D0, 0x10FF), (0x1E00, 0x1EFF), (0x1F00, 0x1FFF), (0x2C80, 0x2CFF))
)
_PLAIN = (_DIGITS, _LATIN, _WESTERN, _CYRILLIC, _GREEK, *_MORE)
_NAME = ("aeiouy", "bcdfghjklmnpqrstvwxz", _WESTERN, "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "αεηιουω", "βγδζθκλμνξπρστφχψ", *_MORE)
#: Sets of alphabets by number.
_SETS = ((_DIGITS,), (_HEX,), (_DIGITS, _LATIN), _PLAIN, _NAME)
DIGITS, HEX, CODE, PLAIN, NAME = range(1, 6)
_LOW_BITS = 21


@functools.cache
def _ranges() -> str:
    """Runs of neighbouring letters and digits of one script without case, which the alphabets leave out: start and length in one number each."""
    known = {c for letters in _PLAIN for c in (*letters, *letters.upper())}
    runs, last = [], None
    for code in range(0x80, 0x30000):
        char = chr(code)
        kind = unicodedata.category(char)
        script = unicodedata.name(char, "").split(" ")[0] if (kind[0] == "L" or kind == "Nd") and char not in known else ""
        if script and script == last:
            runs[-1][1] += 1
        elif script:
            runs.append([code, 1])
        last = script
    return ",".join(str(n << _LOW_BITS | code) for code, n in runs if n > 1)


# First names by gender and script; a surrogate comes from the list of the original.
NAMES = {
    "male_latin": "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Steven Paul Andrew Peter Hans Jürgen Wolfgang Pierre Jacques François José Miguel Javier Carlos".split(),
    "female_latin": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Sandra Ashley Emily Donna Michelle Ursula Sabine Ingrid Brigitte Chantal Françoise María Carmen Dolores Lucía".split(),
    "male_cyrillic": "Александр Дмитрий Сергей Андрей Алексей Михаил Иван Николай Владимир Павел".split(),
    "female_cyrillic": "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Людмила".split(),
}
_TITLE = r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Господин|Госпожа)\.?"
_WORD = r"\p{Lu}\p{Ll}+"
_KNOWN = "(?:" + "|".join(name for names in NAMES.values() for name in names) + ")"

#: Kinds in order of preference. Quantifiers that could run back are possessive or start at a word's edge, so a scan is linear.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]+\.)+\p{L}{2,}",
    "secret": r"(?<=(?i:token|secret|password|api_key|apikey) ?[=:] ?[\"'])[^\"'\s]{8,}",
    "hex": r"(?<![\p{L}\p{N}])[0-9A-Fa-f]{32,64}+(?![\p{L}\p{N}])",
    "key": r"(?<![\p{L}\p{N}])AKIA[0-9A-Z]{16}(?![\p{L}\p{N}])",
    "ipv6": r"(?<![\p{L}\p{N}:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\p{L}\p{N}:])",
    "ipv4": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\p{L}\d])\d(?:[ -]?\d){12,18}(?!\d)",
    "phone": r"(?<![\p{L}\d+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\d)",
    "person": rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE} {_WORD}(?: {_WORD}){{0,2}}|{_KNOWN}(?: {_WORD}){{1,2}})(?![\p{{L}}\p{{N}}])",
}
#: What each kind can start with, tested before its pattern; no mention starts inside a word.
_STARTS = {"secret": r"(?<=[\"'])", "ipv6": "(?=[0-9A-Fa-f]{1,4}:)", "ipv4": "(?=[0-9])", "iban": "(?=[A-Z]{2}[0-9])", "ssn": "(?=[0-9])", "card": "(?=[0-9])", "phone": "(?=[0-9+(])", "person": r"(?=\p{Lu})"}
PATTERN = r"(?<![\p{L}\p{N}])(?:" + "|".join(f"{_STARTS.get(kind, '')}(?:{pattern})" for kind, pattern in KINDS.items()) + ")"
_SIGNS = "[0-9@\"']"  # every kind but names has one of these
_NAMED = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}])(?:{_TITLE} \p{{Lu}}|{_KNOWN} )"


def _chars(text: Column) -> Column:
    some = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)))
    return F.when(F.length(text) > 0, some).otherwise(F.array().cast("array<string>"))


def _seed(key: str, part: str) -> Column:
    return F.lit(hashlib.sha256(f"{part}\0{key}".encode()).hexdigest())


def permuted(values: Column, sizes: Column, tweak: Column, key: str, part: Column) -> Column:
    """Keyed one-to-one map of the numbers ``values[i] < sizes[i]``: each round moves every second one by a hash of the others."""

    def run(sizes: Column) -> Column:
        def turn(state: Column, r: Column) -> Column:
            others = F.array_join(F.transform(F.filter(state, lambda _, j: j % 2 != r % 2), lambda x: x.cast("string")), ",")
            moved = lambda seen: F.transform(
                state,
                lambda x, i: F.when(i % 2 == r % 2, F.pmod(x + F.xxhash64(_seed(key, "turn"), part, r, tweak, i, seen, F.size(state)), F.get(sizes, i))).otherwise(x),
            )
            return let(others, moved)

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.transform(values, lambda x: x.cast("long")), turn)

    return let(F.transform(sizes, lambda x: x.cast("long")), run)


def _cells(text: Column, letters: Column) -> Column:
    """Each character with its alphabet or, for letters without case, its range, and its place and the size of either; none for other characters."""
    ranges = F.split(F.lit(_ranges()), ",").cast("array<bigint>")

    def cell(char: Column) -> Column:
        own = F.get(F.filter(letters, lambda a: F.instr(a, F.lower(char)) > 0), F.lit(0))
        code = F.ascii(char).cast("bigint")
        low = lambda r: r.bitwiseAND((1 << _LOW_BITS) - 1)
        inside = lambda r: (code >= low(r)) & (code < low(r) + F.shiftright(r, _LOW_BITS))
        pair = F.struct(own.alias("own"), F.when(own.isNull() & (code > 127), F.get(F.filter(ranges, inside), F.lit(0))).alias("range"))
        return let(
            pair,
            lambda p: F.struct(
                char.alias("char"), p["own"].alias("own"), low(p["range"]).alias("low"),
                F.coalesce(F.instr(p["own"], F.lower(char)) - 1, code - low(p["range"])).alias("place"),
                F.coalesce(F.length(p["own"]), F.shiftright(p["range"], _LOW_BITS)).alias("size"),
            ),
        )

    return F.transform(_chars(text), cell)


def respelled(text: Column, alphabets: Column, tweak: Column, key: str, part: Column) -> Column:
    """The text with its characters permuted within their alphabets (number of a set), other letters within their script; signs and case stay."""
    letters = F.get(F.array(*(F.split(F.lit("|".join(members)), "[|]") for members in _SETS)), alphabets - 1)

    def run(cells: Column) -> Column:
        movable = F.filter(cells, lambda c: c["size"].isNotNull())
        shape = F.array_join(F.transform(movable, lambda c: F.coalesce(F.substring(c["own"], 1, 1), c["low"].cast("string"))), "")

        def put(found: Column) -> Column:
            def add(state: Column, cell: Column) -> Column:
                place = found[state["k"]]
                new = F.substring(cell["own"], (place + 1).cast("int"), F.lit(1))
                new = F.when(cell["char"] == F.lower(cell["char"]), new).otherwise(F.upper(new))
                new = F.when(cell["own"].isNull(), F.decode(F.unhex(F.lpad(F.hex(cell["low"] + place), 8, "0")), "UTF-32")).otherwise(new)
                still = cell["size"].isNull()
                return F.struct(F.concat(state["out"], F.when(still, cell["char"]).otherwise(new)).alias("out"), (state["k"] + (~still).cast("int")).alias("k"))

            return F.aggregate(cells, F.struct(F.lit("").alias("out"), F.lit(0).alias("k")), add, lambda s: s["out"])

        values, sizes = F.transform(movable, lambda c: c["place"]), F.transform(movable, lambda c: c["size"])
        return let(permuted(values, sizes, F.concat_ws("|", tweak, shape), key, part), put)

    return let(let(letters, lambda some: _cells(text, some)), run)


def _luhn(digits: Column) -> Column:
    """Check digit of a string of digits."""
    def weigh(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        double = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, double).otherwise(d)

    return F.pmod(10 - F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), weigh) % 10, F.lit(10))


def _refilled(mention: Column, digits: Column) -> Column:
    """The mention with its digits replaced in order."""
    def add(state: Column, char: Column) -> Column:
        is_digit = char.rlike("[0-9]")
        return F.struct(
            F.concat(state["out"], F.when(is_digit, F.substring(digits, state["k"], F.lit(1))).otherwise(char)).alias("out"),
            (state["k"] + is_digit.cast("int")).alias("k"),
        )

    return F.aggregate(_chars(mention), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), add, lambda s: s["out"])


def _segment(part: str, text: Column, alphabets: int = 0, tweak: Column | None = None) -> Column:
    """A piece of a mention; without alphabets it stays."""
    return F.struct(F.lit(part).alias("part"), text.alias("text"), F.lit(alphabets).alias("alphabets"), (F.lit("") if tweak is None else tweak).alias("tweak"))


def _names(key: str) -> tuple[Column, Column]:
    """Listed first names, and each one's surrogate: the name a keyed number of places on in the list of its gender and script."""
    old, new = [], []
    for group, names in NAMES.items():
        shift = int(hashlib.sha256(f"{group}\0{key}".encode()).hexdigest(), 16) % (len(names) - 1) + 1
        old += names
        new += names[shift:] + names[:shift]
    return F.split(F.lit(" ".join(old)), " "), F.split(F.lit(" ".join(new)), " ")


def _segments(m: Column, kind: Column, key: str, listed_names: bool = True) -> Column:
    """The pieces of a mention that are respelled each on its own; without ``listed_names`` known first names are, like any other."""
    domain = F.substring_index(m, "@", -1)
    top = F.substring_index(domain, ".", -1)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    code = F.regexp_extract(m, r"^\+\d{1,3}(?=[ .(-])", 0)
    digits = F.regexp_replace(m, "[^0-9]", "")
    old, new = _names(key)

    def word(w: Column, i: Column) -> Column:
        listed = F.get(new, F.array_position(old, w).cast("int") - 1) if listed_names else F.lit(None).cast("string")
        text = F.concat(F.when(i > 0, " ").otherwise(""), F.coalesce(listed, w))
        return F.struct(F.lit("name").alias("part"), text.alias("text"), F.when(listed.isNotNull() | w.rlike(f"^{_TITLE}$"), 0).otherwise(NAME).alias("alphabets"), F.lit("").alias("tweak"))

    return (
        F.when(kind == "email", F.array(
            _segment("local", F.substring_index(m, "@", 1), PLAIN, F.lower(domain)), _segment("", F.lit("@")),
            _segment("host", host, PLAIN, F.lower(top)), _segment("", F.concat(F.lit("."), top)),
        ))
        .when(kind == "card", F.array(_segment("card", F.substring(digits, F.lit(1), F.length(digits) - 1), DIGITS)))
        .when(kind == "phone", F.array(_segment("", code), _segment("phone", F.substring(m, F.length(code) + 1, F.length(m)), DIGITS, code)))
        .when(kind == "iban", F.array(_segment("", F.substring(m, 1, 2)), _segment("iban", F.substring(m, F.lit(3), F.length(m)), CODE, F.substring(m, 1, 2))))
        .when(kind == "person", F.transform(F.split(m, " "), word))
        .when(kind.isin("hex", "ipv6"), F.array(_segment("hex", m, HEX)))
        .when(kind == "ssn", F.array(_segment("ssn", m, DIGITS)))
        .when(kind == "key", F.array(_segment("", F.lit("AKIA")), _segment("key", F.substring(m, F.lit(5), F.lit(16)), CODE)))
        .otherwise(F.array(_segment("secret", m, PLAIN)))
    )


def _ipv4(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    out = permuted(parts, F.array_repeat(F.lit(256), 4), F.lit(""), key, F.lit("ipv4"))
    return F.array_join(F.transform(out, lambda x: x.cast("string")), ".")


def _card(m: Column, head: Column) -> Column:
    """The mention with the new digits of all but the last, and a last one as far from the check digit as its own."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    off = F.substring(digits, -1, 1).cast("int") - _luhn(F.substring(digits, F.lit(1), F.length(digits) - 1))
    return _refilled(m, F.concat(head, F.pmod(_luhn(head) + off, F.lit(10)).cast("string")))


def kind_of(m: Column) -> Column:
    """Kind of a mention, the first whose pattern it fits as a whole."""
    out = F.when(m.rlike(r"^[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]+\.)+\p{L}{2,}$"), "email")
    out = out.when(m.rlike(r"^[0-9A-Fa-f]{32,64}$"), "hex").when(m.rlike(r"^AKIA[0-9A-Z]{16}$"), "key").when(m.rlike(r"^[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}$"), "ipv6")
    out = out.when(m.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ipv4").when(m.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9 ]+$"), "iban").when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
    out = out.when(m.rlike(r"^\d(?:[ -]?\d){12,18}$"), "card").when(m.rlike(r"^[+(\d][\d ().-]+$"), "phone")
    return out.when(m.rlike(rf"^(?:{_TITLE}|{_KNOWN}) \p{{Lu}}"), "person").otherwise("secret")


def surrogate(m: Column, kind: Column, key: str, listed_names: bool = True) -> Column:
    """The keyed replacement of a mention: one expression for the pieces of all kinds, so that plans stay small."""
    piece = lambda s: F.when(s["alphabets"] == 0, s["text"]).otherwise(respelled(s["text"], s["alphabets"], s["tweak"], key, s["part"]))
    spelled = F.array_join(F.transform(_segments(m, kind, key, listed_names), piece), "")
    return F.when(kind == "ipv4", _ipv4(m, key)).otherwise(let(spelled, lambda new: F.when(kind == "card", _card(m, new)).otherwise(new)))


def entity(m: Column, kind: Column) -> Column:
    """What mentions of one entity have in common: lower case, and digits alone for numbers."""
    return F.when(kind.isin("card", "phone", "ssn"), F.regexp_replace(m, "[^0-9]", "")).when(kind == "iban", F.regexp_replace(m, " ", "")).otherwise(F.lower(m))


def mentions(text: Column) -> Column:
    """Mentions in text order; null and empty texts have none. Most texts are ruled out by a cheaper search."""
    return F.when(text.rlike(_SIGNS) | text.rlike(_NAMED), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _detailed(found: Column, key: str) -> Column:
    def one(m: Column) -> Column:
        return let(kind_of(m), lambda kind: F.struct(kind.alias("kind"), m.alias("mention"), surrogate(m, kind, key).alias("surrogate")))

    return F.transform(found, one)


def _walked(m: Column, kind: Column, key: str, step: int) -> Column:
    """Another surrogate of a mention: a permutation of its own each step. One whose shape has no room left grows by digits, a secret becomes a hash."""
    out = surrogate(m, kind, f"{key}\0{step}", step <= LISTED_WALKS)
    own = F.concat_ws("|", _seed(key, f"grown{step}"), kind, entity(m, kind))
    if step > WALKS:
        places = min(2 * (step - WALKS), 18)
        digits = F.lpad(F.pmod(F.xxhash64(own), F.lit(10**places)).cast("string"), places, "0")
        out = F.when(kind == "email", F.concat(digits, out)).otherwise(F.concat(out, digits))
    return F.when(kind == "secret", F.sha2(own.cast("binary"), 256)).otherwise(out) if step > 1 else out


def collisions(details: DataFrame, key: str) -> DataFrame:
    """``kind, mention, surrogate`` of the mentions whose surrogate is a real entity or another entity's, with the surrogate they get instead.

    ``details`` holds ``kind, mention, surrogate`` of all mentions, names included. Of several entities with one surrogate the least keeps it.
    Rounds go on until no mention is left.
    """
    rows = details.distinct()
    rows = rows.select("kind", "mention", "surrogate", entity(F.col("mention"), F.col("kind")).alias("entity"), entity(F.col("surrogate"), F.col("kind")).alias("target"))
    both = F.array(F.struct(F.col("entity").alias("value"), F.lit(None).cast("string").alias("owner")), F.struct(F.col("target").alias("value"), F.col("entity").alias("owner")))
    used = rows.select("kind", F.explode(both).alias("u")).select("kind", "u.*").groupBy("kind", "value").agg(
        F.min("owner").alias("keep"), F.max("owner").alias("last"), F.max(F.col("owner").isNull()).alias("real")
    )
    used = written(used, "used")
    clash = used.filter("keep is not null and (real or keep <> last)").select("kind", F.col("value").alias("target"), "keep", "real")
    taken = rows.join(clash, ["kind", "target"]).filter("real or entity <> keep").select("kind", "mention", "surrogate", "entity")
    open_ = written(taken, "taken")
    given = used.select("kind", F.col("value").alias("target"))
    done = open_.limit(0)
    step = 0
    while not open_.isEmpty():
        step += 1
        moved = open_.withColumn("surrogate", _walked(F.col("mention"), F.col("kind"), key, step))
        moved = written(moved.withColumn("target", entity(F.col("surrogate"), F.col("kind"))), "walked")
        asked = moved.groupBy("kind", "target").agg(F.min("entity").alias("entity"))
        free = asked.join(given.join(asked, ["kind", "target"], "left_semi"), ["kind", "target"], "left_anti")
        settled = written(moved.join(free, ["kind", "target", "entity"], "left_semi"), "settled")
        given = given.unionByName(settled.select("kind", "target"))
        done = done.unionByName(settled.drop("target"))
        open_ = written(open_.join(settled.select("kind", "mention"), ["kind", "mention"], "left_anti"), "taken")
    return done.select("kind", "mention", "surrogate")


def replaced(text: Column, found: Column, new: Column) -> Column:
    """The text with its mentions replaced in order, in one linear pass: the pieces between, joined with the new strings."""
    gaps = F.split(text, PATTERN, -1)
    tail = F.transform(F.sequence(F.lit(1), F.size(found)), lambda i: F.concat(F.element_at(new, i), F.element_at(gaps, i + 1)))
    return F.when(F.size(found) > 0, F.concat(gaps[0], F.array_join(tail, ""))).otherwise(text)


def anonymize(documents: DataFrame, key: str, text: str = "text", found: str = "entities") -> DataFrame:
    """Replace the personal data in ``text`` and add ``found``, an array of kind, mention and surrogate.

    All rows and other columns stay; a column named like ``found`` is replaced. Null stays null and an
    empty text empty, both without entities. Equal texts get equal results, so repeated rows stay repeated.
    """
    details = F.col("_pii.d")
    base = documents.drop(found).withColumn("_pii", F.struct(_detailed(mentions(F.col(text)), key).alias("d")))
    rows = base.filter(F.size(details) > 0).select(F.xxhash64(text).alias("_at"), F.explode(details).alias("e")).select("_at", "e.*")
    rows = written(rows.distinct(), "mentions")
    moved = written(collisions(rows.select("kind", "mention", "surrogate"), key), "moved")
    out = base
    if not moved.isEmpty():
        fixes = rows.drop("surrogate").join(moved, ["kind", "mention"]).groupBy("_at").agg(
            F.map_from_entries(F.collect_set(F.struct("mention", "surrogate"))).alias("_fix")
        )
        out = base.withColumn("_at", F.xxhash64(text)).join(fixes, "_at", "left")
        fixed = F.transform(details, lambda e: F.struct(e["kind"].alias("kind"), e["mention"].alias("mention"), F.coalesce(F.element_at("_fix", e["mention"]), e["surrogate"]).alias("surrogate")))
        out = out.withColumn("_pii", F.struct(fixed.alias("d"))).drop("_at", "_fix")
    new = F.transform(details, lambda e: e["surrogate"])
    out = out.withColumn(text, replaced(F.col(text), details, new)).withColumn(found, details).drop("_pii")
    return out
