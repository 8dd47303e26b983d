"""Personal data replaced by keyed surrogates.

Entities are found by patterns.  A surrogate is decided by a key, the entity's
type and its normal form, so one entity has one surrogate everywhere
(coreference), and keeps its format: separators, lengths, country code,
check-digit validity of card numbers, script and gender of names.  Letters of
e-mail surrogates are lower case.

Phone numbers, card numbers and addresses go through a keyed permutation (a
Feistel network on their digits), which cannot make two of them equal.  E-mail
addresses, family names and given names are drawn from a keyed stream, each by
itself: "Mr John Smith", "Mr. Smith" and "Mrs Smith" share a family name, and so
do their surrogates.  All distinct ones of the table are checked, and every one
but the smallest of those that share a surrogate is drawn again from a larger
space until all differ.  Names are found behind a title.

Only DataFrame functions are used.  Texts are rewritten in the task that reads
them; what was drawn again comes to the texts that hold it by a broadcast up to
``MOST_BROADCAST`` values, and by a join on the text's digest beyond.

Defined results: a null text stays null and holds nothing; an empty text stays
empty; repeated rows are rewritten alike; an empty table gives an empty table.
Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cloakframe.llm.common import apart, checkpointed, let, spliced
from cloakframe.llm.secret_scan import _located

ROUNDS = 6
MOST_BROADCAST = 100_000

# Titles that show a gender, names by script and gender, endings of made-up names.
TITLES = {"f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Госпожа"), "m": ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Господин")}
NAMES = {
    ("latin", "f"): ("Anna", "Clara", "Elena", "Emma", "Ines", "Julia", "Laura", "Maria", "Nora", "Sara", "Sofia", "Vera"),
    ("latin", "m"): ("Adam", "Bruno", "David", "Emil", "Felix", "Hugo", "Jonas", "Leo", "Martin", "Oscar", "Paul", "Viktor"),
    ("cyrillic", "f"): ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Иван", "Лев", "Олег", "Павел", "Юрий"),
}
ENDINGS = {("latin", "f"): "a", ("latin", "m"): "o", ("cyrillic", "f"): "а", ("cyrillic", "m"): "ий"}
SYLLABLES = {
    "latin": ("ba", "den", "fel", "gor", "hal", "kin", "lo", "mar", "nes", "or", "pel", "rin", "sta", "tor", "ul", "win"),
    "cyrillic": ("ба", "ден", "фел", "гор", "хал", "кин", "ло", "мар", "нес", "ор", "пел", "рин", "ста", "тор", "ул", "вин"),
}


def digest(*parts: Column) -> Column:
    """48 bits of an MD5 digest as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("bigint")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _power(n: Column) -> Column:
    return F.rint(F.pow(F.lit(10.0), n)).cast("bigint")


def permuted(number: Column, key: Column) -> Column:
    """A permutation of the digit strings of each length (2 to 34)."""
    left, right = F.floor(F.char_length(number) / 2).cast("int"), F.ceil(F.char_length(number) / 2).cast("int")

    def step(state: Column, r: Column) -> Column:
        mixed = lambda half: digest(key, F.char_length(number).cast("string"), r.cast("string"), half.cast("string"))
        return F.when(r % 2 == 0, F.struct(F.pmod(state["l"] + mixed(state["r"]), _power(left)).alias("l"), state["r"].alias("r"))).otherwise(
            F.struct(state["l"].alias("l"), F.pmod(state["r"] + mixed(state["l"]), _power(right)).alias("r"))
        )

    start = F.struct(F.substr(number, F.lit(1), left).cast("bigint").alias("l"), F.substr(number, left + 1, right).cast("bigint").alias("r"))
    done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(F.lpad(s["l"].cast("string"), left, "0"), F.lpad(s["r"].cast("string"), right, "0")))
    return F.when(F.char_length(number) >= 2, done).otherwise(number)


def _redressed(value: Column, new: Column) -> Column:
    """``value`` with its digits replaced, in order, by those of ``new``."""

    def step(state: Column, c: Column) -> Column:
        is_digit = c.rlike("[0-9]")
        return F.struct((state["at"] + F.when(is_digit, 1).otherwise(0)).alias("at"), F.concat(state["out"], F.when(is_digit, F.substr(new, state["at"] + 1, F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(F.split(value, ""), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: s["out"])


def _luhn(number: Column) -> Column:
    """The check digit that would stand behind ``number``."""

    def add(total: Column, d: Column, i: Column) -> Column:
        twice = F.when(i % 2 == 0, 2 * d).otherwise(d)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    figures = F.transform(F.reverse(F.split(number, "")), lambda c, i: F.struct(c.cast("int").alias("d"), i.alias("i")))
    return F.pmod(10 - F.aggregate(figures, F.lit(0), lambda t, x: add(t, x["d"], x["i"])) % 10, F.lit(10))


def _phone(value: Column, norm: Column, key: Column, attempt: object) -> Column:
    country = F.regexp_extract(value, r"^(\+[0-9]{1,3}(?=[^0-9]))", 1)
    return let(F.substr(value, F.char_length(country) + 1, F.char_length(value)), lambda rest: F.concat(country, _redressed(rest, permuted(digits(rest), key))))


def _card(value: Column, norm: Column, key: Column, attempt: object) -> Column:
    """All digits but the last are permuted; the last keeps its distance from the check digit."""
    body = F.substr(norm, F.lit(1), F.char_length(norm) - 1)

    def finish(new: Column) -> Column:
        off = F.pmod(F.substr(norm, F.char_length(norm), F.lit(1)).cast("int") - _luhn(body), F.lit(10))
        return _redressed(value, F.concat(new, F.pmod(_luhn(new) + off, F.lit(10)).cast("string")))

    return let(permuted(body, key), finish)


def _address(value: Column, norm: Column, key: Column, attempt: object) -> Column:
    """The 32 bits of an IPv4 address, permuted."""
    octets = F.split(value, r"\.")
    half = lambda i: F.get(octets, F.lit(i)).cast("bigint") * 256 + F.get(octets, F.lit(i + 1)).cast("bigint")

    def step(s: Column, r: Column) -> Column:
        mixed = lambda h: digest(key, F.lit("ip"), r.cast("string"), h.cast("string"))
        return F.when(r % 2 == 0, F.struct(F.pmod(s["l"] + mixed(s["r"]), F.lit(65536)).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), F.pmod(s["r"] + mixed(s["l"]), F.lit(65536)).alias("r")))

    parts = lambda h: F.concat_ws(".", F.floor(h / 256).cast("string"), (h % 256).cast("string"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(half(0).alias("l"), half(2).alias("r")), step, lambda s: F.concat_ws(".", parts(s["l"]), parts(s["r"])))


def _email(value: Column, attempt: Column, key: Column) -> Column:
    """Letters and digits of the part before the last dot are drawn anew, signs stay; late attempts add letters."""
    norm = F.lower(value)
    stem = F.regexp_extract(norm, r"^(.*)(\.[^.]*)$", 1)
    tail = F.regexp_extract(norm, r"^(.*)(\.[^.]*)$", 2)

    def draw(c: Column, i: Column) -> Column:
        n = digest(key, norm, i.cast("string"))
        return F.when(c.rlike("[0-9]"), (n % 10).cast("string")).when(c.rlike(r"\p{L}"), F.chr(97 + n % 26)).otherwise(c)

    more = F.transform(F.sequence(F.lit(0), attempt), lambda i: F.chr(97 + digest(key, norm, F.concat(F.lit("more"), i.cast("string"))) % 26))
    more = F.array_join(F.slice(more, F.lit(1), F.greatest(attempt - 3, F.lit(0))), "")
    return F.concat(more, F.array_join(F.transform(F.split(stem, ""), draw), ""), tail)


def _pick(options: tuple[str, ...], n: Column) -> Column:
    return F.get(F.array(*map(F.lit, options)), F.pmod(n, F.lit(len(options))).cast("int"))


def _by_script(value: Column, name: Callable[[str], Column]) -> Column:
    """A name in the value's script, in capitals if it is."""
    new = F.when(value.rlike(r"\p{IsCyrillic}"), name("cyrillic")).otherwise(name("latin"))
    loud = (F.char_length(value) > 1) & (value == F.upper(value)) & (value != F.lower(value))
    return let(new, lambda x: F.when(loud, F.upper(x)).otherwise(x))


def _syllables(script: str, value: Column, key: Column, what: str, n: Column) -> Column:
    drawn = F.transform(F.sequence(F.lit(1), n), lambda i: _pick(SYLLABLES[script], digest(key, F.concat(F.lit(what), i.cast("string")), F.lower(value))))
    return F.initcap(F.array_join(drawn, ""))


def _family(value: Column, attempt: Column, key: Column) -> Column:
    """Three syllables, and one more for each attempt."""
    return _by_script(value, lambda script: _syllables(script, value, key, "family", attempt + 3))


def _given(value: Column, female: Column, attempt: Column, key: Column) -> Column:
    """A name of the same gender; late attempts make one up, with the gender's ending."""

    def name(script: str) -> Column:
        known = lambda g: _pick(NAMES[script, g], digest(key, F.lit("given"), F.lower(value)))
        made = F.concat(_syllables(script, value, key, "given", attempt + 1), F.when(female, ENDINGS[script, "f"]).otherwise(ENDINGS[script, "m"]))
        return F.when(attempt == 0, F.when(female, known("f")).otherwise(known("m"))).otherwise(made)

    return _by_script(value, name)


def _name_parts(value: Column) -> tuple[Column, Column, Column, Column]:
    """(title, given name or "", family name, whether the title is a woman's)."""
    title = F.regexp_extract(value, r"^(\S+) ", 1)
    return title, F.regexp_extract(value, r"^\S+ (\S+) \S+$", 1), F.regexp_extract(value, r"(\S+)$", 1), F.regexp_replace(title, r"\.", "").isin(*TITLES["f"])


def _email_units(value: Column) -> Column:
    return F.array(F.struct(F.concat(F.lit("email|"), F.lower(value)).alias("unit"), value.alias("value")))


def _person_units(value: Column) -> Column:
    """Family and given name: each has one surrogate wherever it stands, with whatever title."""
    _, given, family, female = _name_parts(value)
    unit = lambda name, v: F.struct(F.concat(name, F.lower(v)).alias("unit"), v.alias("value"))
    both = F.array(unit(F.lit("family|"), family), unit(F.when(female, "given|f|").otherwise("given|m|"), given))
    return F.when(given == "", F.slice(both, 1, 1)).otherwise(both)


def _of_unit(unit: Column, value: Column, attempt: Column, key: Column) -> Column:
    return F.when(unit.startswith("email|"), _email(value, attempt, key)).when(unit.startswith("family|"), _family(value, attempt, key)).otherwise(_given(value, unit.startswith("given|f|"), attempt, key))


def _new_email(value: Column, norm: Column, key: Column, attempt: Callable[[Column], Column]) -> Column:
    return _email(value, attempt(_email_units(value)[0]["unit"]), key)


def _new_person(value: Column, norm: Column, key: Column, attempt: Callable[[Column], Column]) -> Column:
    title, given, family, female = _name_parts(value)
    units = _person_units(value)
    first = F.when(given == "", "").otherwise(F.concat(F.lit(" "), _given(given, female, attempt(F.get(units, F.lit(1))["unit"]), key)))
    return F.concat(title, first, F.lit(" "), _family(family, attempt(units[0]["unit"]), key))


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    normal: Callable[[Column], Column]
    surrogate: Callable[[Column, Column, Column, Callable[[Column], Column]], Column]
    units: Callable[[Column], Column] | None = None  # what is drawn and has to differ; None: a permutation, which does


_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Listed first wins where spans overlap.  Repeated groups are bounded: the regex
#: engine recurses once for each repetition, and a text may be very long.
KINDS = (
    Kind("email", r"(?<![\p{L}0-9._+-])[\p{L}0-9_][\p{L}0-9._+-]*@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,63}", F.lower, _new_email, _email_units),
    Kind("ip", rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])", lambda v: v, _address),
    Kind("phone", r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9])\+[0-9]{1,3}[ .-][0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9])", digits, _phone),
    Kind("card", r"(?<![0-9])(?:[0-9]{16}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])", digits, _card),
    Kind("person", r"(?<![\p{L}])(?:" + "|".join(t for g in TITLES.values() for t in g) + r")\.? \p{Lu}\p{L}+(?: \p{Lu}\p{L}+)?", lambda v: F.regexp_replace(F.lower(v), r"\.", ""), _new_person, _person_units),
)


def with_entities(df: DataFrame, text_col: str, name: str, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``df`` with an array of (start, end, kind, value, norm), sorted, without overlaps."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    for n, kind in enumerate(kinds):
        of_kind = _typed(_located(text, kind.pattern), n, kind)
        if n == 0:
            df = df.withColumn(name, of_kind)
        else:
            df = df.withColumn("__more", of_kind).withColumn(name, F.concat(name, apart(F.col(name), F.col("__more"))))
    return df.withColumn(name, F.array_sort(name)).drop("__more")


def _typed(spans: Column, n: int, kind: Kind) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(n).alias("kind"), s["value"].alias("value"), kind.normal(s["value"]).alias("norm")))


def surrogate(entity: Column, key: str, attempt: Callable[[Column], Column], kinds: tuple[Kind, ...] = KINDS) -> Column:
    """The replacement of one entity; ``attempt`` gives how often a unit was drawn again."""
    out = F.when(F.lit(False), "")
    for n, kind in enumerate(kinds):
        out = out.when(entity["kind"] == n, kind.surrogate(entity["value"], entity["norm"], F.lit(f"{key}|{kind.name}"), attempt))
    return out


def _units(entity: Column, kinds: tuple[Kind, ...]) -> Column:
    out = F.when(F.lit(False), F.expr("cast(array() as array<struct<unit:string,value:string>>)"))
    for n, kind in enumerate(kinds):
        if kind.units is not None:
            out = out.when(entity["kind"] == n, kind.units(entity["value"]))
    return F.coalesce(out, F.expr("cast(array() as array<struct<unit:string,value:string>>)"))


def redrawn(found: DataFrame, key: str, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """(unit, attempt) of the distinct units of ``found`` (columns unit, value) that collide at first.

    Units are e-mail addresses, family names and given names.  Every one but the
    smallest of those that share a surrogate is drawn again, from a larger
    space each time, so rounds end whatever their number.
    """
    each = checkpointed(found.groupBy("unit").agg(F.min("value").alias("value")).withColumn("attempt", F.lit(0)))
    type_of = F.substring_index("unit", "|", 1)
    keyed = F.concat(F.lit(f"{key}|"), F.when(type_of == "email", "email").otherwise("person"))
    for attempt in count(1):
        named = each.withColumn("type", type_of).withColumn("made", F.lower(_of_unit(F.col("unit"), F.col("value"), F.col("attempt"), keyed)))
        keeps = named.groupBy("type", "made").agg(F.min(F.struct("attempt", "unit")).alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("type", "made", "keeper")
        clash = Observation()
        again = named.join(keeps, ["type", "made"]).filter(F.col("keeper.unit") != F.col("unit")).select("unit", F.lit(attempt).alias("new"))
        again = checkpointed(again.observe(clash, F.count(F.lit(1)).alias("rows")))
        if not clash.get.get("rows"):
            return each.filter("attempt > 0").select("unit", "attempt")
        each = checkpointed(each.join(again, "unit", "left").select("unit", "value", F.coalesce("new", "attempt").alias("attempt")))


def pseudonymise(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """(id, text, entities): texts with surrogates; entities as found in the original."""
    # written with what was found, so that texts are searched once
    rows = checkpointed(with_entities(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("original")), "original", "found", kinds))
    units = F.flatten(F.transform("found", lambda e: _units(e, kinds)))
    again = checkpointed(redrawn(rows.select(F.explode(units).alias("u")).select("u.*"), key, kinds))
    if again.isEmpty():
        attempt = lambda unit: F.lit(0)
    else:
        # the attempts of a text's own units, by text digest: equal texts share them, texts without units need none
        rows = rows.withColumn("units", F.array_distinct(F.transform(units, lambda u: u["unit"])))
        rows = rows.withColumn("text_key", F.when(F.size("units") > 0, F.sha2("original", 256)).otherwise(F.coalesce(F.col("id").cast("string"), F.lit(""))))
        held = rows.filter(F.size("units") > 0).select("text_key", F.explode("units").alias("unit")).distinct()
        of_text = checkpointed(held.join(again, "unit").groupBy("text_key").agg(F.map_from_entries(F.collect_list(F.struct("unit", "attempt"))).alias("attempts")))
        few = of_text.select(F.sum(F.size("attempts"))).first()[0] <= MOST_BROADCAST
        rows = rows.join(F.broadcast(of_text) if few else of_text, "text_key", "left").withColumn("attempts", F.coalesce("attempts", F.expr("cast(map() as map<string,int>)")))
        attempt = lambda unit: F.coalesce(F.try_element_at(F.col("attempts"), unit), F.lit(0))
    text = spliced(F.col("original"), F.col("found"), lambda e: surrogate(e, key, attempt, kinds))
    return rows.select("id", text.alias("text"), F.transform("found", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), F.get(F.array(*[F.lit(k.name) for k in kinds]), e["kind"]).alias("kind"))).alias("entities"))
