"""PII: keyed surrogates of the same type, format, script and gender, in DataFrame expressions only.

One pattern finds the mentions of a text, in one pass. Names found so beside a title or a given name are then looked for in
the rest of the same text, where they stand alone, unless they are common words too: words that more documents have in lower
case than have them as such a name ("Dr House" does not make "the White House" a person). These are replaced only where they
speak or own something. A mention's entity is its type and its value without formatting, so spellings of one number or address share a surrogate everywhere (coreference). A candidate surrogate is a keyed hash of
entity and attempt, cast into the entity's form: every letter becomes another letter of its script, every digit another
digit. It is accepted when no other entity has it and it is no real value found in the corpus; losers try again
with the next attempt. Hosts of addresses are entities of their own. Given names are exchanged within their gender and
script by a keyed cycle, which needs no check.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import staged, table

# Common given names by (script, gender), and forms of address.
GIVEN_NAMES = {
    ("latin", "f"): (
        "Mary Anna Laura Sophie Emma Julia Claudia Sarah Elena Marie Carmen Lucia Ingrid Susan Linda Karen Emily Olivia Jennifer Jessica"
        " Elizabeth Patricia Barbara Margaret Catherine Charlotte Isabella Sofia Camille Chloé Françoise Hélène Ana María Pilar Greta Heike"
        " Ursula Fatima Aisha Priya Ananya Yuki Mei"
    ).split(),
    ("latin", "m"): (
        "John James Robert Michael William David Thomas Peter Paul Hans Jürgen Pierre Carlos José Antonio Martin Richard Charles Joseph"
        " Christopher Daniel Matthew Anthony Andrew Kevin George Edward Alexander Jean François Louis Juan Luis Miguel Pedro Klaus Wolfgang"
        " Stefan Andreas Mohammed Ahmed Rahul Arjun Hiroshi"
    ).split(),
    ("cyrillic", "f"): "Анна Мария Ольга Елена Наталья Татьяна Ирина Светлана Екатерина Юлия".split(),
    ("cyrillic", "m"): "Иван Сергей Алексей Дмитрий Андрей Михаил Николай Павел Александр Владимир".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Βασιλική".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Νίκος Γιάννης Κώστας".split(),
}
ADDRESSED = "Mr Mrs Ms Miss Dr Prof Herr Frau Madame Monsieur Señor Señora".split()
# Letters by script, vowels first; Latin letters with marks; and stretches of letters of other scripts.
LETTERS = {
    "latin": ("aeiou", "bcdfghjklmnpqrstvwxyz"),
    "cyrillic": ("аеиоуыэюя", "бвгджзклмнпрстфхцчшщ"),
    "greek": ("αεηιουω", "βγδζθκλμνξπρσςτφχψ"),
}
MARKED = ("àáâãäåèéêëìíîïòóôõöøùúûüýœæ", "çñßłńśźżćčšžřďťňğ")
BLOCKS = {
    "greek, accented": (0x3AC, 0x3CE), "cyrillic": (0x430, 0x45F), "armenian": (0x561, 0x586), "hebrew": (0x5D0, 0x5EA), "arabic": (0x628, 0x63A),
    "arabic, second row": (0x641, 0x64A), "devanagari": (0x905, 0x939), "bengali": (0x995, 0x9A8), "thai": (0xE01, 0xE2E), "georgian": (0x10D0, 0x10F0),
    "hiragana": (0x304B, 0x3082), "katakana": (0x30AB, 0x30E2), "han": (0x4E00, 0x9FA5), "hangul": (0xAC00, 0xD7A3),
}


def _either(words: list[str]) -> str:
    """A pattern of the words, as they are or in capitals, tried by first letter."""
    forms: dict[str, list[str]] = {}
    for w in sorted({f for w in words for f in (w, w.upper())}, key=lambda w: (-len(w), w)):
        forms.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in sorted(forms.items()))


_names = _either([n for names in GIVEN_NAMES.values() for n in names])
_sirs = _either(ADDRESSED)
_surname = r"(?:\p{Lu}['’])?\p{Lu}[\p{L}\p{M}]+(?:['’-]\p{Lu}[\p{L}\p{M}]+)*"
_octet = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
PATTERNS = (
    r"(?<![\p{L}\p{N}])[\p{L}\p{N}][\p{L}\p{N}\p{M}._%+-]*+@(?:[\p{L}\p{N}\p{M}-]+\.)+\p{L}{2,}",
    r"(?<![\w.])" + _octet + r"(?:\." + _octet + r"){3}(?!\w|\.\d)",
    r"(?<![\w+])\+?\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)",
    r"(?<![\w+])\+\d{1,3}(?:[ .-]\d{2,4}){3,5}(?!\d)",
    r"(?<![\w-])\(?\d{3}\)?[ .-]\d{3}[.-]\d{4}(?![\w-])",
    r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    r"(?<!\w)\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?!\w)",
    r"(?<!\w)3[47]\d{2}([ -]?)\d{6}\2\d{5}(?!\w)",
    r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    r"(?<!\p{L})(?=\p{Lu})(?:" + _names + r")(?= (?:\p{Lu}\. )?(?:\p{Lu}['’])?\p{Lu}\p{L})",
    r"(?<=(?<!\p{L})(?:" + _names + r") (?:\p{Lu}\. )?)" + _surname,
    r"(?<=(?<!\p{L})(?:" + _sirs + r")\.? )(?:" + _surname + r"|[\p{Lo}\p{IsGeorgian}][\p{L}\p{M}]+)",
    r"(?<=(?<!\p{L})(?:" + _sirs + r")\.? \p{Lu}[\p{L}\p{M}]{1,20} )" + _surname,
)
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS)
#: A cheaper test that every text with a mention passes.
HINT = rf"@|\d\.\d|\d[ .)(-]*\d[ .)(-]*\d[ .)(-]*\d|[A-Z]{{2}}\d\d|(?<!\p{{L}})(?=\p{{Lu}})(?:{_names}|(?:{_sirs})\.?) [\p{{Lu}}\p{{Lo}}\p{{IsGeorgian}}]"
#: Marks before a name that stands alone, and before one that speaks or owns something; they are no characters of text.
ALONE, PERSON = "\ufdd1", "\ufdd2"
SPEAKS = "said says asked answered replied told wrote writes explained added sagte sagt fragte schrieb dit demanda répondit écrit dijo dice preguntó escribió".split()
NAME = r"^[\p{L}\p{M}'’-]+$"
KEY = "surrogates"
MAX_ATTEMPTS = 64


def kind_of(mention: Column) -> Column:
    """email, ip, given, name, card, ssn, iban or phone; a function of the mention's text."""
    digits = F.regexp_replace(mention, r"\D", "")
    given = F.lower(mention).isin([n.lower() for names in GIVEN_NAMES.values() for n in names])
    return (
        F.when(mention.contains("@"), "email")
        .when(mention.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(given, "given")
        .when(mention.rlike(NAME), "name")
        .when(mention.rlike(r"^\p{L}"), "iban")
        .when(mention.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(mention.rlike(r"^\d+[ -]?\d+[ -]?\d+[ -]?\d+$") & F.length(digits).isin(15, 16), "card")
        .otherwise("phone")
    )


def value_of(mention: Column, kind: Column) -> Column:
    """The mention without formatting: what mentions of one entity have in common."""
    return F.when(kind.isin("email", "name", "given", "ip"), F.lower(mention)).otherwise(F.upper(F.regexp_replace(mention, r"[^\p{L}\d]", "")))


def _with(value: Column, body) -> Column:
    """body(value), where value is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _bytes(stream: Column) -> Column:
    """The 64 bytes of a SHA-512 in hex."""
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.conv(F.substring(stream, 2 * i + 1, F.lit(2)), 16, 10).cast("int"))


def _chars(text: Column, one) -> Column:
    """`text` with every character c at place i (from 1) replaced by one(c, i)."""
    each = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: one(F.substring(text, i, F.lit(1)), i))
    return F.when(F.length(text) > 0, F.array_join(each, "")).otherwise("")


_known = ["0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", *(letters for pair in LETTERS.values() for letters in pair)]
_every = "".join(_known)
_starts = [_every.index(letters) for letters in _known for _ in letters]
_sizes = [len(letters) for letters in _known for _ in letters]


def _alike(text: Column, random: Column) -> Column:
    """Another letter for every letter, of its script (vowels for vowels where they are known), another digit for every digit.

    Letters of scripts that are not listed become Latin ones. Marks and signs stay. random: array of 64 bytes.
    """
    code_point = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 4, "0")), "UTF-16BE")
    blocks = F.array(*[F.struct(F.lit(low).alias("low"), F.lit(high).alias("high")) for low, high in BLOCKS.values()])

    def one(c: Column, i: Column) -> Column:
        b = F.element_at(random, (i - 1) % 64 + 1)
        at = F.instr(F.lit(_every), c)
        start, size = F.element_at(F.lit(_starts), at), F.element_at(F.lit(_sizes), at)
        # from its own place on by 1 to n - 1: never itself
        other = F.substring(F.lit(_every), start + (at - start + b % (size - 1)) % size + 1, F.lit(1))
        out = F.when(at > 0, other)
        for marked, plain in zip(MARKED, LETTERS["latin"]):
            out = out.when(F.instr(F.lit(marked), c) > 0, F.substring(F.lit(plain), b % len(plain) + 1, F.lit(1)))
        code = F.ascii(c)
        block = F.get(F.filter(blocks, lambda x: code.between(x["low"], x["high"])), 0)
        moved = _with(block, lambda x: code_point(x["low"] + (code - x["low"] + 1 + b * 89 % (x["high"] - x["low"])) % (x["high"] - x["low"] + 1)))
        out = out.when(block.isNotNull(), moved)
        return out.when(c.rlike(r"\p{L}"), F.substring(F.lit(LETTERS["latin"][1]), b % 20 + 1, F.lit(1))).when(c.rlike(r"\p{N}"), (b % 10).cast("string")).otherwise(c)

    return _chars(text, one)


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string of any length."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 0, 2 * d).otherwise(d)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def _mod97(text: Column) -> Column:
    """The remainder by 97 of digits and capitals, A as 10 to Z as 35."""

    def add(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(text, i, F.lit(1)))
        return F.when(code >= 65, rest * 100 + code - 55).otherwise(rest * 10 + code - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), add)


def _end(text: Column, first: int) -> Column:
    return F.substring(text, F.lit(first), F.length(text))


def surrogate_value(kind: Column, value: Column, host: Column, attempt: int, key: str) -> Column:
    """A candidate for an entity's value, of the same form. `host` is the surrogate of an address's host."""
    stream = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, value, F.lit(str(attempt))), 512)
    top = F.when(kind == "host", F.regexp_extract(value, r"\.\p{L}+$", 0)).otherwise("")
    stem = F.when(kind == "email", F.substring_index(value, "@", 1)).otherwise(F.substring(value, F.lit(1), F.length(value) - F.length(top)))
    # where forms are short and nearly all taken, later attempts are a letter longer every eighth time
    more = F.when(kind.isin("email", "host", "name"), F.left(F.reverse(stem), F.lit(attempt // 8))).otherwise("") if attempt >= 8 else F.lit("")

    def numbered(fresh: Column) -> Column:
        lead = F.when(kind == "iban", 2).when(kind == "card", 1).otherwise(F.greatest(F.length(value) - 10, F.lit(0)))
        body = F.concat(F.substring(value, F.lit(1), lead), F.substring(fresh, lead + 1, F.length(value)))
        stem = F.substring(body, F.lit(1), F.length(body) - 1)
        luhn = F.concat(stem, F.pmod(-_luhn(F.concat(stem, F.lit("0"))), F.lit(10)).cast("string"))
        country, account = F.substring(value, 1, 2), _end(body, 5)
        check = F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
        is_iban = (kind == "iban") & (_mod97(F.concat(_end(value, 5), F.substring(value, 1, 4))) == 1)
        return F.when((kind == "card") & (_luhn(value) % 10 == 0), luhn).when(is_iban, F.concat(country, check, account)).otherwise(body)

    def made(random: Column) -> Column:
        ip = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (F.element_at(random, i) % 223 + 1).cast("string")), ".")
        shaped = lambda fresh: (
            F.when(kind == "email", F.concat(fresh, F.lit("@"), host)).when(kind == "host", F.concat(fresh, top)).when(kind == "name", fresh).otherwise(numbered(fresh))
        )
        return F.when(kind == "ip", ip).otherwise(_with(_alike(F.concat(stem, more), random), shaped))

    return _with(_bytes(stream), made)


def render(mention: Column, kind: Column, surrogate: Column) -> Column:
    """The surrogate in the mention's format: its separators, and its upper and lower case."""

    def cased(s: Column, i: Column) -> Column:
        c = F.substring(mention, i, F.lit(1))
        return F.when((c != F.lower(c)), F.upper(s)).otherwise(s)

    def fill(c: Column, i: Column) -> Column:
        place = F.length(F.regexp_replace(F.substring(mention, F.lit(1), i), r"[^\p{L}\d]", ""))
        return F.when(c.rlike(r"[\p{L}\d]"), F.substring(surrogate, place, F.lit(1))).otherwise(c)

    capitals = kind.isin("given", "name") & (mention == F.upper(mention)) & (mention != F.lower(mention))
    out = F.when(capitals, F.upper(surrogate)).when(kind.isin("ip", "given"), surrogate)
    return out.when(kind.isin("email", "name"), _chars(surrogate, cased)).otherwise(_chars(mention, fill))


def given_names(key: str) -> dict[str, str]:
    """Every listed given name, lower case -> another of the same script and gender, by a keyed cycle."""
    out = {}
    for names in GIVEN_NAMES.values():
        cycle = sorted(names, key=lambda n: hashlib.sha256(f"{key}\x1f{n}".encode()).digest())
        out |= {a.lower(): b for a, b in zip(cycle, cycle[1:] + cycle[:1])}
    return out


def _distinct_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, value, surrogate for distinct (kind, value), which have a column host too."""
    parts = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # values are few bytes and many steps each, so they are dealt out before they are cast
    real = staged(entities.select("kind", "value", "host").repartition(parts, "value"), "entities")
    done, pending = None, real.repartition(parts, "value")
    for attempt in range(MAX_ATTEMPTS):
        tried = pending.withColumn("surrogate", surrogate_value(F.col("kind"), F.col("value"), F.col("host"), attempt, key))
        tried = staged(tried, "tried")
        first = tried.groupBy("kind", "surrogate").agg(F.min("value").alias("value"))
        free = first.join(real.select("kind", F.col("value").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        free = free.select("kind", "value", "surrogate")
        done = staged(free if done is None else done.unionByName(free), "surrogates")
        pending = staged(tried.select("kind", "value", "host").join(done, ["kind", "value"], "left_anti"), "pending")
        if pending.limit(1).count() == 0:
            return done
    raise ValueError("values of some kind and form are nearly all taken")


def surrogates(entities: DataFrame, *, key: str = KEY) -> DataFrame:
    """kind, value, surrogate for distinct (kind, value): distinct within a kind, and no real value of that kind.

    Hosts of addresses get surrogates first, distinct too, but for the reserved example.com, .net and .org, which stay.
    """
    host = F.when(F.col("kind") == "email", F.substring_index("value", "@", -1))
    named = staged(entities.select("kind", "value", host.alias("_host")), "values")
    hosts = named.where(F.col("_host").isNotNull() & ~F.col("_host").rlike(r"(^|\.)example\.(com|net|org)$"))
    hosts = hosts.select(F.lit("host").alias("kind"), F.col("_host").alias("value"), F.lit(None).cast("string").alias("host")).distinct()
    hosts = _distinct_surrogates(hosts, key).select(F.col("value").alias("_host"), F.col("surrogate").alias("_new"))
    return _distinct_surrogates(named.join(hosts, "_host", "left").select("kind", "value", F.coalesce("_new", "_host").alias("host")), key)


def mention_pieces(text: Column) -> Column:
    """`text` cut into what is between mentions (even places, from 0) and mentions (odd places); joined it is the text.

    The first pass is by PATTERN; the second by the names that the first one found, where they begin with a capital; such
    a mention has ALONE or PERSON before it.
    """
    # a mark that no text holds: it has the hash of the text
    mark = F.concat(F.lit("\ufdd0"), F.hex(F.xxhash64(text)))
    around = lambda sign: F.concat(mark, F.lit(sign + "$0"), mark)
    joined = lambda pieces: F.call_function("array_join", pieces, mark)

    def again(pieces: Column) -> Column:
        names = F.filter(pieces, lambda p, i: (i % 2 == 1) & p.rlike(NAME))
        longest_first = F.reverse(F.array_sort(F.array_distinct(F.transform(names, lambda n: F.struct(F.length(n), F.lower(n).alias("n"))))))
        either = F.concat(F.lit(r"(?=[\p{Lu}\p{Lo}\p{IsGeorgian}])(?iu:"), F.array_join(F.transform(longest_first, lambda s: s["n"]), "|"), F.lit(r")(?![\p{L}\p{M}])"))
        # no capital or article right before it, a possessive or a verb of speech right after it
        person = lambda e: F.concat(F.lit(r"(?<![\p{L}\p{M}])(?<!\p{Lu}[\p{L}\p{M}]{0,20} )(?<!\b(?:the|a|an) )"), e, F.lit(rf"(?=['’]s\b| (?:{'|'.join(SPEAKS)})\b)"))
        alone = lambda e: F.concat(F.lit(rf"(?<![\p{{L}}\p{{M}}{PERSON}])"), e)
        both = lambda p, e: F.regexp_replace(F.regexp_replace(p, person(e), around(PERSON)), alone(e), around(ALONE))
        marked = _with(either, lambda e: joined(F.transform(pieces, lambda p, i: F.when(i % 2 == 0, both(p, e)).otherwise(p))))
        return F.when(F.size(names) > 0, F.split(marked, mark, -1)).otherwise(pieces)

    return _with(F.split(F.regexp_replace(text, F.lit(PATTERN), around("")), mark, -1), again)


def common_words(docs: DataFrame, found: DataFrame) -> DataFrame:
    """value: names of `found` (d1, d2, mention, value, kind) that more documents have in lower case than have as a name beside a title or a given name.

    Counted over all of `docs`, once a document. Words are shuffled as counts, and names that are never written in lower case are no words.
    """
    named = found.where((F.col("kind") == "name") & ~F.col("mention").rlike(f"^[{ALONE}{PERSON}]")).select("value", "d1", "d2").distinct()
    named = named.groupBy("value").agg(F.count("*").alias("named"))
    lower = F.filter(F.array_distinct(F.split("text", r"[^\p{L}\p{M}'’-]+")), lambda w: w.rlike(r"^\p{Ll}"))
    words = docs.select(F.explode(lower).alias("value")).groupBy("value").agg(F.count("*").alias("written"))
    return words.join(named, "value").where("written > named").select("value")


def replace_pii(docs: DataFrame, *, key: str = KEY) -> DataFrame:
    """`docs` with the mentions in text replaced, and n_entities, the number of mentions replaced; other columns stay.

    Texts without a mention, empty and null ones stay as they are, with n_entities 0. Equal texts get equal results; repeated rows and null
    doc_ids are kept as they are. A column named n_entities is replaced. An empty table gives an empty result.
    """
    columns = [c for c in docs.columns if c != "n_entities"]
    names = F.create_map(*[F.lit(x) for pair in given_names(key).items() for x in pair])
    text = F.col("text")
    hinted = F.coalesce(text.rlike(HINT), F.lit(False))
    rest = [F.col(f"`{c}`") for c in columns if c != "text"]
    cut = docs.where(hinted).select(
        F.struct(F.lit(0).alias("_"), *rest).alias("row"), F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(1), "text").alias("d2"), mention_pieces(text).alias("pieces")
    )
    cut = staged(cut, "pieces")  # every text is searched once
    is_mention = lambda _, i: i % 2 == 1
    found = staged(cut.select("d1", "d2", F.explode(F.filter("pieces", is_mention)).alias("mention")).distinct(), "mentions")
    bare = F.ltrim(F.col("mention"), F.lit(ALONE + PERSON))
    found = found.withColumn("bare", bare).withColumn("kind", kind_of(bare)).withColumn("value", value_of(F.col("bare"), F.col("kind")))
    words = staged(common_words(docs, found), "words").withColumn("_alone", F.lit(True))
    found = found.withColumn("_alone", F.startswith("mention", F.lit(ALONE))).join(words, ["value", "_alone"], "left_anti")
    known = surrogates(found.where("kind <> 'given'").select("kind", "value").distinct(), key=key)
    shown = (
        found.join(known, ["kind", "value"], "left")
        .withColumn(
            "shown",
            render(F.col("bare"), F.col("kind"), F.when(F.col("kind") == "given", F.try_element_at(names, "value")).otherwise(F.col("surrogate"))),
        )
        .groupBy("d1", "d2")
        .agg(F.map_from_entries(F.collect_set(F.struct("mention", "shown"))).alias("shown"))
    )
    shown = staged(shown, "shown")
    swapped = F.array_join(F.transform("pieces", lambda p, i: F.when(i % 2 == 1, F.coalesce(F.try_element_at("shown", p), F.ltrim(p, F.lit(ALONE + PERSON)))).otherwise(p)), "")
    replaced = F.size(F.filter("pieces", lambda p, i: (i % 2 == 1) & F.try_element_at("shown", p).isNotNull())).cast("long")
    made = cut.join(shown, ["d1", "d2"], "left").select("row", swapped.alias("swapped"), F.coalesce(replaced, F.lit(0)).cast("long").alias("replaced"))
    out = [F.col("made").getField("swapped").alias("text") if c == "text" else F.col("made").getField("row").getField(c).alias(c) for c in columns]
    changed = made.select(F.struct("row", "swapped", "replaced").alias("made")).select(*out, F.col("made").getField("replaced").alias("n_entities"))
    same = docs.where(~hinted).select(*[F.col(f"`{c}`") for c in columns], F.lit(0).cast("long").alias("n_entities"))
    return changed.unionByName(same)


def op4_pii(spark, sf_dir):
    return replace_pii(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities")


QUERIES = {"op4_pii": op4_pii}
ORACLES: dict[str, str] = {}
