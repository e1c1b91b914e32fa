"""PII surrogates: detected entities get keyed, type-consistent replacements.

Only column expressions are used.  One regular expression finds all entities
of a text, in one pass whose result is written.  Distinct entities
(pre-aggregated before they move) are normalised, and each gets a surrogate
drawn from a keyed SHA-256 of its kind, its normal form and an attempt number:

  * coreference: forms of one entity (case of an address, punctuation of a
    telephone number) share the normal form, so they share the surrogate,
    written in each form's own format.  Given and family names are entities of
    their own, so "Dr John Smith", "Mr John Smith" and "Mr Smith" share what
    they have in common, as do "Иванов" and "Иванова";
  * format: digits stay digits, letters stay letters of their case, separators
    stay; cards keep their issuer's first two digits and pass the Luhn check, account
    numbers (IBAN) keep country and length and pass the check modulo 97; mail
    addresses lie in domains reserved for examples; private network addresses
    stay private and public ones public; names keep title, gender and script;
  * gender: of a title, or for a neutral one of the titles that the given name
    has elsewhere in the corpus;
  * distinctness: surrogates that meet another surrogate of their kind or an
    entity of the corpus are drawn again, until no two entities share one.
    After WIDEN_AFTER attempts names gain syllables, addresses and secrets
    characters, and private addresses move to 10.0.0.0/8.  Entities of a fixed
    format that found no free value in MOST_ATTEMPTS take one another's.

Scope.  Mail addresses; secrets after a word such as token or password; IBAN;
card numbers of payment issuers (beginning with 3 to 6, or 22 to 27) that pass the Luhn check; IPv4 addresses; US social security
numbers; telephone numbers of ten digits in groups, or with + and a country
code; names of one or two words in Latin, Cyrillic or Greek after one of TITLES
(a single word is a family name).  Names without a title, other scripts, IPv6
and postal addresses are not detected.

The key is the caller's and has no default.

Documents without entities pass without a shuffle; the others meet the
surrogates of their distinct entities in equi-joins.

Defined results
  * null and empty texts are unchanged, with no entities;
  * repeated rows are treated alike; rows that share a doc_id, and rows with a
    null one, are each replaced by their own entities;
  * an empty table stays empty; extra columns are carried; a column whose name
    starts with ``pii_`` is refused;
  * the same key gives the same surrogates, unless a collision with other
    entities of the corpus moved one to its next attempt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bucketwise.llm.common import materialize, no_columns, temporary

#: Attempts before surrogates of names, addresses and secrets grow, and between
#: one further syllable or character and the next.
WIDEN_AFTER, WIDEN_EVERY = 8, 4
#: Attempts after which entities of a fixed format take one another's values.
MOST_ATTEMPTS = 40

# Given names for surrogates by gender and script, and syllables of family names.
GIVEN = {
    ("m", "latin"): "Adam Alan Boris Carl Daniel Emil Felix Georg Henry Ivan Jonas Karl Leon Martin Noah Oscar Paul Robert Simon Tobias Victor Walter".split(),
    ("f", "latin"): "Alice Anna Bella Clara Diana Emma Flora Greta Helen Irene Julia Karin Laura Maria Nora Olivia Paula Rosa Sofia Teresa Vera Wanda".split(),
    ("u", "latin"): "Alex Andrea Ariel Charlie Dominique Francis Jamie Jordan Kim Lee Morgan Quinn Robin Sam Sasha Taylor".split(),
    ("m", "cyrillic"): "Алексей Борис Виктор Георгий Денис Егор Иван Кирилл Леонид Максим Николай Олег Павел Роман Сергей Фёдор".split(),
    ("u", "cyrillic"): "Женя Саша Валя Слава Миша Никита Лёня Шура".split(),
    ("m", "greek"): "Αλέξανδρος Γιώργος Δημήτρης Κώστας Νίκος Παύλος Πέτρος Στέφανος Χρήστος Θωμάς".split(),
    ("f", "greek"): "Άννα Βασιλική Ελένη Ειρήνη Κατερίνα Μαρία Σοφία Δέσποινα Χριστίνα Όλγα".split(),
    ("u", "greek"): "Φώτης Χάρις Φάνης Αγγελική Λάμπρος Ζωή".split(),
    ("f", "cyrillic"): "Алина Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лариса Мария Нина Ольга Полина Светлана Юлия".split(),
}
SYLLABLES = {
    "latin": "bar bel cor dan del fen gar hal hol jen kal ker lan lin mar mel nor nel per ral ran sel sol tam tor val ver wen wil yor".split(),
    "cyrillic": "бар бел вол гор дан дол жук зар кал кор лан лод мар мел нов нор орл пав пет рам ров сав сол тар тим ула фом хар чер шим".split(),
    "greek": "βαρ γαλ δημ ζαχ θεο καλ κων λαμ μαν μιχ νικ παν παπ πετ σαβ στα τσι φωτ χαρ χρι".split(),
}
ENDINGS = {"latin": "son", "cyrillic": "ов", "greek": "ίδης"}
#: What a family name in the female form adds to the male one.
FEMALE = {"cyrillic": "а"}
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "г-н"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "г-жа"),
    "u": ("Dr", "Prof"),
}

_ALL_TITLES = sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True)
_UP, _LOW = r"[\p{Lu}&&[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}]]", r"[\p{Ll}'’-]"
_NAME = rf"(?:%s)\.? {_UP}{_LOW}+(?: {_UP}{_LOW}+)?" % "|".join(_ALL_TITLES)
#: A card number in the groups that cards have; no other entity can hide in it.
_GROUPED = r"(?:\d{13,19}|\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3}|\d{4} \d{6} \d{4,5}|\d{4}-\d{6}-\d{4,5})(?!\d)(?![A-Za-z0-9._%+-]*@)"
#: A whole run of 13 to 19 digits with spaces or hyphens anywhere: other entities
#: may be inside, but none reaches beyond it.
_RUN = r"\d(?:[ -]?\d){12,18}(?!\d|[ .-]\d)(?![A-Za-z0-9._%+-]*@)"
#: In order of precedence where two could start at one place.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?i:token|api[_-]?key|secret|password|passwd|pwd)\s?[=:]\s?\"?[A-Za-z0-9+/_-]{8,}\"?",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]|-\d)",
    "card": f"{_RUN}|{_GROUPED}",
    "ip": r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}(?!\d)",
    "phone": r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{3})[ .-]?\d{3}[ .-]\d{4}(?!\d)|\+\d{1,3}(?:[ .-]\d{1,8}){2,5}(?!\d|[.-]\d)",
    "name": _NAME,
}


def _any(patterns: dict[str, str]) -> str:
    """An entity does not start inside a word or a number."""
    return r"(?<![\p{L}\p{N}])(?:" + "|".join(f"(?:{p})" for p in patterns.values()) + ")"


ENTITY = _any(PATTERNS)
#: What is looked for in a run of digits that turned out to be no card.
INNER = _any(PATTERNS | {"card": _GROUPED})

#: First numbers of public IPv4 networks without special ones inside (fixed values).
_PUBLIC = [n for n in range(1, 224) if n not in (10, 100, 127, 169, 172, 192, 198, 203)]
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def kind_of(raw: Column) -> Column:
    """The kind of a match of ENTITY: the first pattern that is all of it."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(raw.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def _secret_value(raw: Column) -> Column:
    return F.regexp_extract(raw, r"[=:]\s?\"?([A-Za-z0-9+/_-]{8,})\"?$", 1)


def normal_form(kind: Column, raw: Column) -> Column:
    """What the forms of one entity (of a kind other than name) have in common."""
    digits = F.regexp_replace(raw, r"\D", "")
    country = F.regexp_extract(raw, r"^\+(\d{1,3})[ .(-]", 1)
    abroad = (country != "") & (country != "1")
    national = F.when(abroad, F.substring(digits, F.length(country) + 1, F.length(digits))).otherwise(
        F.substring(digits, F.greatest(F.length(digits) - 9, F.lit(1)), F.lit(10))
    )
    return (
        F.when(kind == "email", F.lower(raw))
        .when(kind == "secret", _secret_value(raw))
        .when(kind == "phone", national)
        .when(kind == "iban", F.regexp_replace(raw, " ", ""))
        .when(kind == "ip", raw)
        .otherwise(digits)
    )


def gender_of(raw: Column) -> Column:
    out = F.lit("u")
    for gender in ("f", "m"):
        out = F.when(raw.rlike(r"^(?:%s)\.? " % "|".join(TITLES[gender])), F.lit(gender)).otherwise(out)
    return out


def _title(raw: Column) -> Column:
    return F.regexp_extract(raw, r"^((?:%s)\.? )" % "|".join(_ALL_TITLES), 1)


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _family(word: Column) -> Column:
    """A family name in lower case, in its male form where that is regular."""
    return F.regexp_replace(F.lower(word), r"(?<=[оеё]в|[иы]н)а$", "")


def name_parts(raw: Column) -> tuple[Column, Column]:
    """(given, family) of a name with its title, as written; given may be empty."""
    words = F.split(F.regexp_replace(raw, r"^(?:%s)\.? " % "|".join(_ALL_TITLES), ""), " ")
    two = F.size(words) == 2
    return F.when(two, words[0]).otherwise(F.lit("")), F.when(two, words[1]).otherwise(words[0])


def _stream(seed: Column, i: Column) -> Column:
    """The i-th number (0 to 65535) of the keyed stream of ``seed``."""
    block = F.sha2(F.concat(seed, F.lit("#"), F.floor(i / 16).cast("string")), 256)
    return F.conv(F.substring(block, F.pmod(i, F.lit(16)) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _pick(alphabet: str, number: Column) -> Column:
    return F.substring(F.lit(alphabet), F.pmod(number, F.lit(len(alphabet))) + 1, F.lit(1))


def _same_shape(text: Column, seed: Column, hexadecimal: Column | None = None) -> Column:
    """``text`` with its letters and digits drawn anew, each from its class."""
    lower = _LOWER if hexadecimal is None else None

    def draw(c: Column, i: Column) -> Column:
        n = _stream(seed, i)
        small = _pick(_LOWER, n) if lower else F.when(hexadecimal, _pick("abcdef", n)).otherwise(_pick(_LOWER, n))
        return (
            F.when(c.rlike("[0-9]"), _pick(_DIGITS, n))
            .when(c.rlike("[a-z]"), small)
            .when(c.rlike("[A-Z]"), _pick(_UPPER, n))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), draw), "")


def _luhn(digits: Column) -> Column:
    """``digits`` followed by their Luhn check digit."""
    places = F.reverse(F.split(digits, ""))
    worth = F.transform(
        places,
        lambda d, i: F.when(
            F.pmod(i, F.lit(2)) == 0,
            F.when(d.cast("int") * 2 > 9, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2),
        ).otherwise(d.cast("int")),
    )
    total = F.aggregate(worth, F.lit(0), lambda a, x: a + x)
    return F.concat(digits, F.pmod(-total, F.lit(10)).cast("string"))


def _further(parts: list[str], seed: Column, number: Column) -> Column:
    """``number`` further parts, drawn from the keyed stream of ``seed``."""
    drawn = F.transform(
        F.sequence(F.lit(1), F.greatest(number, F.lit(1))),
        lambda k: F.element_at(F.lit(parts), F.pmod(_stream(F.concat(seed, F.lit("+")), k), F.lit(len(parts))) + 1),
    )
    return F.when(number > 0, F.array_join(drawn, "")).otherwise(F.lit(""))


def _check_digits(country: Column, account: Column) -> Column:
    """The two digits after which an IBAN is 1 modulo 97."""
    def digit(c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(F.upper(c)) - 55)

    rest = F.aggregate(
        F.split(F.concat(account, country, F.lit("00")), ""),
        F.lit(0),
        lambda a, c: F.pmod(F.when(digit(c) > 9, a * 100).otherwise(a * 10) + digit(c), F.lit(97)).cast("int"),
    )
    return F.lpad((F.lit(98) - rest).cast("string"), 2, "0")


def _address(norm: Column, seed: Column, attempt: Column) -> Column:
    """An IPv4 address of the same class: private (or of one machine or link) or public."""
    part = lambda k, low, high: (F.pmod(_stream(seed, F.lit(k)), F.lit(high - low + 1)) + low).cast("string")
    public = F.concat_ws(".", F.element_at(F.lit(_PUBLIC), F.pmod(_stream(seed, F.lit(0)), F.lit(len(_PUBLIC))) + 1).cast("string"), part(1, 0, 255), part(2, 0, 255), part(3, 1, 254))
    ten = F.concat_ws(".", F.lit("10"), part(1, 0, 255), part(2, 0, 255), part(3, 1, 254))
    narrow = attempt < WIDEN_AFTER
    return (
        F.when(norm.rlike(r"^127\."), F.concat_ws(".", F.lit("127"), part(1, 0, 255), part(2, 0, 255), part(3, 1, 254)))
        .when(norm.rlike(r"^192\.168\."), F.when(narrow, F.concat_ws(".", F.lit("192.168"), part(2, 0, 255), part(3, 1, 254))).otherwise(ten))
        .when(norm.rlike(r"^172\.(?:1[6-9]|2\d|3[01])\."), F.when(narrow, F.concat_ws(".", F.lit("172"), part(1, 16, 31), part(2, 0, 255), part(3, 1, 254))).otherwise(ten))
        .when(norm.rlike(r"^169\.254\."), F.when(narrow, F.concat_ws(".", F.lit("169.254"), part(2, 0, 255), part(3, 1, 254))).otherwise(ten))
        .when(norm.rlike(r"^10\."), ten)
        .otherwise(public)
    )


def _given(norm: Column, seed: Column, further: Column) -> Column:
    """norm: gender, script, name."""
    gender, script = F.split_part(norm, F.lit(":"), F.lit(1)), F.split_part(norm, F.lit(":"), F.lit(2))
    out = F.lit(None).cast("string")
    for (g, s), given in GIVEN.items():
        first = F.element_at(F.lit(given), F.pmod(_stream(seed, F.lit(0)), F.lit(len(given))) + 1)
        out = F.when((script == s) & (gender == g), F.concat(F.lower(first), _further(SYLLABLES[s], seed, further))).otherwise(out)
    return F.concat_ws(":", gender, script, out)


def _family_name(norm: Column, seed: Column, further: Column) -> Column:
    """norm: script, name."""
    script = F.split_part(norm, F.lit(":"), F.lit(1))
    out = F.lit(None).cast("string")
    for s, syllables in SYLLABLES.items():
        part = [F.element_at(F.lit(syllables), F.pmod(_stream(seed, F.lit(k)), F.lit(len(syllables))) + 1) for k in (1, 2, 3)]
        out = F.when(script == s, F.concat(*part, _further(syllables, seed, further), F.lit(ENDINGS[s]))).otherwise(out)
    return F.concat_ws(":", script, out)


def surrogate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a normal form, itself in normal form."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, norm, attempt.cast("string")), 256)
    past = (attempt - WIDEN_AFTER).cast("int")
    further = F.when(past >= 0, F.floor(past / WIDEN_EVERY) + 1).otherwise(F.lit(0)).cast("int")
    hexadecimal = norm.rlike("^[0-9a-f]+$")
    local = F.regexp_extract(norm, r"^(.*)@", 1)
    domain = F.concat(
        F.lit("m"),
        F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), F.regexp_extract(norm, r"@(.*)$", 1)), 256), 1, 6),
        F.lit(".example.net"),
    )
    country, account = F.substring(norm, 1, 2), _same_shape(F.substring(norm, 5, 1 << 20), seed)
    body = F.concat(F.substring(norm, 1, 2), _same_shape(F.substring(norm, F.lit(3), F.length(norm) - 3), seed))
    return (
        F.when(kind == "email", F.concat(_same_shape(local, seed), _further(list(_LOWER), seed, further), F.lit("@"), domain))
        .when(
            kind == "secret",
            F.concat(
                _same_shape(norm, seed, hexadecimal),
                F.when(hexadecimal, _further(list(_DIGITS), seed, further)).otherwise(_further(list(_LOWER), seed, further)),
            ),
        )
        .when(kind == "ip", _address(norm, seed, attempt))
        .when(kind == "card", _luhn(body))
        .when(kind == "iban", F.concat(country, _check_digits(country, account), account))
        .when(kind == "given", _given(norm, seed, further))
        .when(kind == "family", _family_name(norm, seed, further))
        .otherwise(_same_shape(norm, seed))
    )


def render(kind: Column, raw: Column, norm: Column, new: Column) -> Column:
    """``new`` (a normal form) in the format that ``raw`` has."""
    # letters and digits of raw are replaced in turn; a country code that the
    # normal form leaves out stays as it is
    skip = F.length(F.regexp_replace(raw, r"[^A-Za-z0-9]", "")) - F.length(new)
    filled = F.aggregate(
        F.split(raw, ""),
        F.struct(F.lit("").alias("s"), F.lit(0).alias("n")),
        lambda a, c: F.when(
            c.rlike("[A-Za-z0-9]"),
            F.struct(
                F.concat(a["s"], F.when(a["n"] < skip, c).otherwise(F.substring(new, a["n"] - skip + 1, F.lit(1)))).alias("s"),
                (a["n"] + 1).alias("n"),
            ),
        ).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["n"].alias("n"))),
        lambda a: a["s"],
    )
    return (
        F.when(kind == "email", F.when((raw == F.upper(raw)) & (raw != F.lower(raw)), F.upper(new)).otherwise(new))
        .when(kind == "secret", F.replace(raw, norm, new))
        .when(kind == "ip", new)
        .otherwise(filled)
    )


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, new) for distinct (kind, norm): no two of a kind share a
    surrogate, and, but for the last resort, none is itself an entity of its kind."""
    known = entities.select("kind", F.col("norm").alias("new"))
    open_, settled = entities.select("kind", "norm"), None
    for attempt in range(MOST_ATTEMPTS):
        drawn = open_.withColumn("new", surrogate(F.col("kind"), F.col("norm"), F.lit(attempt), key))
        drawn = materialize(drawn, "surrogates")
        taken = known if settled is None else known.unionByName(settled.select("kind", "new"))
        first = Window.partitionBy("kind", "new").orderBy("norm")
        judged = (
            drawn.withColumn("place", F.row_number().over(first))
            .join(taken.withColumn("taken", F.lit(True)), ["kind", "new"], "left")
            .select("kind", "norm", "new", ((F.col("place") == 1) & F.col("taken").isNull()).alias("good"))
        )
        judged = materialize(judged, "surrogates")
        good = judged.where("good").select("kind", "norm", "new")
        settled = good if settled is None else settled.unionByName(good)
        open_ = judged.where("not good").select("kind", "norm")
        if not open_.limit(1).count():
            return settled
    # no entity's own value is a surrogate so far, so those that are left can take
    # one another's in a ring, closed by a settled one so that none keeps its own
    closing = settled.groupBy("kind").agg(F.min("norm").alias("norm")).join(open_.select("kind").distinct(), "kind", "left_semi")
    ring = open_.withColumn("left", F.lit(True)).unionByName(closing.withColumn("left", F.lit(False)))
    order = Window.partitionBy("kind").orderBy(F.sha2(F.concat_ws("|", F.lit(key), "kind", "norm"), 256))
    around = Window.partitionBy("kind").orderBy(F.sha2(F.concat_ws("|", F.lit(key), "kind", "norm"), 256)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    taken = ring.withColumn("new", F.coalesce(F.lead("norm").over(order), F.first("norm").over(around)))
    return settled.unionByName(taken.where("left").select("kind", "norm", "new"))


def _names(names: DataFrame, key: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The given and family names in ``names`` (raw) as entities (kind, norm),
    and what writes the names anew from their surrogates."""
    given, family = name_parts(F.col("raw"))
    parts = names.select("raw", given.alias("given"), family.alias("family"), gender_of(F.col("raw")).alias("gender"))
    parts = parts.withColumn("script", _script(F.concat("given", "family")))
    # a given name's gender: that of its titles, where they agree
    genders = (
        parts.where((F.col("given") != "") & (F.col("gender") != "u"))
        .groupBy("script", F.lower("given").alias("lower"))
        .agg(F.min("gender").alias("low"), F.max("gender").alias("high"))
    )
    parts = parts.withColumn("lower", F.lower("given")).join(genders, ["script", "lower"], "left")
    agreed = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.lit("u"))
    parts = parts.select(
        "raw",
        "given",
        "family",
        "script",
        F.coalesce(F.nullif("gender", F.lit("u")), agreed).alias("gender"),
        F.when(F.col("given") != "", F.concat_ws(":", agreed, "script", "lower")).alias("given_norm"),
        F.concat_ws(":", "script", _family(F.col("family"))).alias("family_norm"),
    )
    parts = materialize(parts, "names")
    entities = parts.select(
        F.explode(F.array(F.struct(F.lit("given").alias("kind"), F.col("given_norm").alias("norm")), F.struct(F.lit("family").alias("kind"), F.col("family_norm").alias("norm")))).alias("e")
    ).select("e.*").where("norm is not null")

    def write(chosen: DataFrame) -> DataFrame:
        of = lambda kind: chosen.where(F.col("kind") == kind).select(F.col("norm").alias(f"{kind}_norm"), F.element_at(F.split("new", ":"), -1).alias(f"{kind}_new"))
        both = parts.join(of("given"), "given_norm", "left").join(of("family"), "family_norm", "left")
        female = F.lit(False)
        for script in FEMALE:
            own = F.lower("family") != F.split_part("family_norm", F.lit(":"), F.lit(2))
            female = F.when(F.col("script") == script, own | (F.col("gender") == "f")).otherwise(female)
        ending = F.lit("")
        for script, more in FEMALE.items():
            ending = F.when((F.col("script") == script) & female, F.lit(more)).otherwise(ending)
        name = F.concat_ws(" ", F.initcap("given_new"), F.initcap(F.concat("family_new", ending)))
        return both.select("raw", F.concat(_title(F.col("raw")), name).alias("written"))

    return entities.distinct(), write


def replacements(forms: DataFrame, key: str) -> DataFrame:
    """(raw, written) for distinct entities as they are written (``raw``)."""
    forms = materialize(forms.select("raw", kind_of(F.col("raw")).alias("kind")), "forms")
    names, write = _names(forms.where("kind = 'name'"), key)
    others = forms.where("kind <> 'name'").withColumn("norm", normal_form(F.col("kind"), F.col("raw")))
    entities = materialize(others.select("kind", "norm").distinct().unionByName(names), "entities")
    chosen = surrogates(entities, key)
    written = others.join(chosen, ["kind", "norm"]).select(
        "raw", render(F.col("kind"), F.col("raw"), F.col("norm"), F.col("new")).alias("written")
    )
    return written.unionByName(write(chosen))


def _is_entity(raw: Column) -> Column:
    """A number that looks like a card's is one only if a card issuer's numbers
    begin like it and its check digit is right."""
    digits = F.regexp_replace(raw, r"\D", "")
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    return ~raw.rlike(f"^(?:{PATTERNS['card']})$") | (digits.rlike("^(?:[3-6]|2[2-7])") & (_luhn(body) == digits))


def _inside(raw: Column) -> Column:
    """Matches inside a run of digits that is no card."""
    return F.regexp_extract_all(raw, F.lit(INNER), F.lit(0))


def _entities(raws: str) -> Column:
    """The entities among matches of ENTITY, and those inside matches that are none."""
    each = F.transform(raws, lambda r: F.when(_is_entity(r), F.array(r)).otherwise(F.filter(_inside(r), _is_entity)))
    return F.flatten(each)


def replace_pii(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with entities in ``text`` replaced, and ``pii_found`` (how many).

    ``key``: the secret that the surrogates are drawn with."""
    if not key:
        raise ValueError("surrogates need a key of the caller's")
    no_columns(docs, "pii_")
    raws = F.coalesce(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), F.array().cast("array<string>"))
    # one pass of the expression; all that follows reads its result
    found = docs.withColumn("pii_raw", raws)
    found = found.withColumn("pii_found", F.when(F.size("pii_raw") > 0, F.size(_entities("pii_raw"))).otherwise(F.lit(0)))
    found = materialize(found, "found")
    touched = found.where("pii_found > 0")
    plain = found.where("pii_found = 0").drop("pii_raw")

    forms = touched.select(F.explode(_entities("pii_raw")).alias("raw")).distinct()
    with temporary() as scratch:
        written = scratch.keep(materialize(replacements(forms, key), "replacements"))

    # texts, not ids, carry their entities: ids may be null or repeat
    maps = (
        touched.select(F.sha2(text, 256).alias("pii_text"), F.array_distinct(_entities("pii_raw")).alias("raws"))
        .dropDuplicates(["pii_text"])
        .select("pii_text", F.explode("raws").alias("raw"))
        .join(written, "raw")
        .groupBy("pii_text")
        .agg(F.map_from_entries(F.collect_list(F.struct("raw", "written"))).alias("pii_map"))
    )

    def filled(pieces: Column, between: Column) -> Column:
        return F.array_join(F.zip_with(pieces, between, lambda piece, other: F.concat(piece, F.coalesce(other, F.lit("")))), "")

    def written_as(raw: Column) -> Column:
        return F.coalesce(F.element_at("pii_map", raw), raw)

    def anew(raw: Column) -> Column:
        inside = filled(F.split(raw, INNER, -1), F.transform(_inside(raw), written_as))
        return F.when(_is_entity(raw), written_as(raw)).otherwise(inside)

    new = filled(F.split(text, ENTITY, -1), F.transform("pii_raw", anew))
    replaced = (
        touched.withColumn("pii_text", F.sha2(text, 256))
        .join(maps, "pii_text")
        .withColumn("pii_new", new)
        .withColumn(text, F.col("pii_new"))
    )
    return plain.unionByName(replaced.select(*plain.columns))


#: Key of the registered query and of the pipeline where the session names none:
#: the test tables hold invented data, so it need not be secret.
KEY_SETTING, TEST_KEY = "spark.bucketwise.piiKey", "test tables"


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, None) or TEST_KEY


def op1_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, the text with surrogates, and how many it has."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace_pii(docs, session_key(spark)).select("doc_id", "text", F.col("pii_found").alias("n_replaced"))
