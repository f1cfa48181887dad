"""Secret scans: candidates by pattern, false positives removed by a random forest, in DataFrame expressions only.

A candidate's features are its length and make-up, its character transitions under the bigrams of the corpus's words,
the share of its letters that dictionary words cover, its path, and the words beside it. The
dictionary and the bigrams are counted over all documents. The forest is trained on labelled findings, a bounded sample by hash.
Where none are given they are planted: keys and look-alikes of several families, made by rule, put between words of
the corpus. Their label is how they were made, not what the features see of them.
"""

from __future__ import annotations

import math

from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import staged, table

MAX_ROWS = 20_000
MAX_TEXTS = 1_500
LEAST_COUNT = 5
NEIGHBOUR_CHARS = 60
#: What comes before a value that is a candidate whatever its make: a naming word and an assignment, or a user in an address.
BEFORE = (
    r"(?i:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key)[\w-]{0,20}[\"']?\s{0,3}[=:]\s{0,3}[\"'`]?"
    r"|://[^\s:@/]{1,40}:(?=[^\s@/]{3,}@)"
)
VALUE = r"[^\s\"'`<>,;@]{5,}[^\s\"'`<>,;@.)]"
ALONE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*\d|[A-Z]{16}|[A-Za-z]*[a-z][A-Z])[A-Za-z0-9+/_-]{12,}={0,2}(?![A-Za-z0-9+/_=-])"
#: What BEFORE can start with; looked at first, as most places of a text start with none of them.
STARTS = "(?=[tspacTSPAC:])"
CANDIDATE = rf"({STARTS}(?:{BEFORE}))({VALUE})|({ALONE})"
#: Words that name a secret, and words of examples: as whole words of a name or path (parts between signs or capitals
#: count), and in a value, where words of four letters must be whole.
NAMING = r"(?i)(token|secret|passw(or)?d|passwd|pwd|api[_-]?key|access[_-]?key|auth|bearer|credential|private|client[_-]?id|signature)"
EXAMPLE = r"((?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))(?i:examples?|sample|dummy|placeholder|changeme|your|x{4,}|tests?|fixtures?|mock)(?![a-z]|(?<=[A-Z])[A-Z])"
EXAMPLE_VALUE = rf"(?i:example|sample|dummy|placeholder|changeme|your[_-]|xxxx|fixture)|{EXAMPLE}"
ASSIGNED = r"""["']?\s*[=:]\s*["'`]?$"""
#: The name that a value is assigned to; an address is none.
NAME = r"(?<![@\w-])([\w-]+)" + ASSIGNED
#: A prefix of an issuer's keys that has the word in it.
ISSUED_TEST = "^sk_test_"
FEATURES = (
    "length", "digit_share", "upper_share", "sign_share", "distinct_share", "class_changes", "hex_only", "transitions", "coverage",
    "path_example", "path_depth", "named", "assigned", "quoted", "example_named", "words_beside",
)


def candidates(docs: DataFrame, *, path: str = "source") -> DataFrame:
    """doc_id, nth (from 0 in its text), value, left, right, path: a row for every candidate of every row of `docs`."""
    text = F.col("text")
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    # one pass puts a mark that no text holds, as it has the text's hash, around every value
    mark = F.concat(F.lit("\ufdd0"), F.hex(F.xxhash64(text)))
    pieces = F.split(F.regexp_replace(text, F.lit(CANDIDATE), F.concat(F.lit("$1"), mark, F.lit("$2$3"), mark)), mark, -1)
    cut = docs.where("text is not null").select("doc_id", where.alias("path"), pieces.alias("pieces")).where(F.size("pieces") > 1)
    beside = F.transform(
        F.sequence(F.lit(1), F.size("pieces") - 2, F.lit(2)),
        lambda i: F.struct(
            F.get("pieces", i).alias("value"),
            F.right(F.get("pieces", i - 1), F.lit(NEIGHBOUR_CHARS)).alias("left"),
            F.left(F.get("pieces", i + 1), F.lit(NEIGHBOUR_CHARS)).alias("right"),
        ),
    )
    return cut.select("doc_id", "path", F.posexplode(beside).alias("nth", "hit")).select("doc_id", "nth", "hit.value", "hit.left", "hit.right", "path")


def dictionary(docs: DataFrame, *, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: lower-case runs of at least three letters that occur `least_count` times or more in all texts."""
    words = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word"))
    return words.where(F.length("word") >= 3).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


_CLASSES = "abcdefghijklmnopqrstuvwxyz0."


def _coded(text: Column) -> Column:
    """Lower-case letters, 0 for a digit and . for the rest."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"\d", "0"), r"[^a-z0]", ".")


def _pairs(text: Column) -> Column:
    coded = _coded(text)
    pairs = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(coded, i, F.lit(2)))
    return F.when(F.length(text) > 1, pairs).otherwise(F.array().cast("array<string>"))


def transition_logs(words: DataFrame) -> Column:
    """Log probabilities of one character class after another under the dictionary, 784 in a row; as many counts reach the driver."""
    counts = words.select("n", F.explode(_pairs(F.col("word"))).alias("pair")).groupBy("pair").agg(F.sum("n").alias("n"))
    seen = {r[0]: r[1] for r in counts.collect()}
    total = {a: sum(seen.get(a + b, 0) for b in _CLASSES) for a in _CLASSES}
    return F.lit([math.log((seen.get(a + b, 0) + 1) / (total[a] + len(_CLASSES))) for a in _CLASSES for b in _CLASSES])


def _log_of(pair: Column, logs: Column) -> Column:
    first, second = (F.instr(F.lit(_CLASSES), F.substring(pair, k, 1)) for k in (1, 2))
    return F.element_at(logs, (first - 1) * len(_CLASSES) + second)


def is_example() -> Column:
    """The value itself, or the name it is assigned to, says that it is an example. Other words nearby say nothing of it."""
    value = F.regexp_replace("value", ISSUED_TEST, "")
    return value.rlike(EXAMPLE_VALUE) | F.regexp_extract("left", NAME, 1).rlike(EXAMPLE)


def with_features(found: DataFrame, words: DataFrame, logs: Column | None = None) -> DataFrame:
    """`found` with the columns of FEATURES. `words` is the dictionary, `logs` its `transition_logs` where they are known."""
    logs = transition_logs(words) if logs is None else logs
    value, length = F.col("value"), F.length("value")
    share = lambda p: F.regexp_count(value, F.lit(p)) / length
    values = staged(found.select("value").distinct(), "values")
    runs = values.select("value", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    covered = runs.join(words, "word").groupBy("value").agg(F.sum(F.length("word")).alias("covered"))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "a"), "[A-Z]+", "A"), r"\d+", "0")
    known = values.join(covered, "value", "left").select(
        "value",
        length.cast("double").alias("length"),
        share(r"\d").alias("digit_share"),
        share("[A-Z]").alias("upper_share"),
        share("[^A-Za-z0-9]").alias("sign_share"),
        (F.size(F.array_distinct(F.split(value, ""))) / length).alias("distinct_share"),
        (F.length(kinds) / length).alias("class_changes"),
        value.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double").alias("hex_only"),
        (F.aggregate(_pairs(value), F.lit(0.0), lambda s, p: s + _log_of(p, logs)) / F.greatest(length - 1, F.lit(1))).alias("transitions"),
        (F.coalesce("covered", F.lit(0)) / length).alias("coverage"),
    )
    known = staged(known, "value-features")
    left, right = F.col("left"), F.col("right")
    return found.join(known, "value").select(
        *found.columns,
        *[c for c in known.columns if c != "value"],
        F.col("path").rlike(EXAMPLE).cast("double").alias("path_example"),
        F.regexp_count("path", F.lit("/")).cast("double").alias("path_depth"),
        left.rlike(NAMING).cast("double").alias("named"),
        left.rlike(ASSIGNED).cast("double").alias("assigned"),
        (left.rlike("""["'`]$""") & right.rlike("""^["'`]""")).cast("double").alias("quoted"),
        is_example().cast("double").alias("example_named"),
        F.regexp_count(F.concat(left, right), F.lit(r"\p{L}{2,}")).cast("double").alias("words_beside"),
    )


def _families() -> list[tuple[str, int, Column, tuple[str, ...], str]]:
    """Name, label, value, what may stand before it, and after it; of columns h (hash as hex) and words (some of the corpus)."""
    hexes = F.sha2(F.col("h"), 256)
    mixed = F.translate(F.base64(F.unhex(F.concat(hexes, F.sha2(hexes, 256)))), "+/=", "aZ")  # 84 letters and digits
    word = lambda i: F.lower(F.get("words", i))
    digits = F.translate(hexes, "abcdef", "104392")
    named = ('token = "', "secret: ", 'api_key="', "auth_token = ", 'private_key: "')
    bare = ("", "use ", "with ", "it is ", "(")
    return [
        ("hex token", 1, F.left(hexes, F.lit(40)), named, '"'),
        ("cloud key", 1, F.concat(F.lit("AKIA"), F.left(F.upper(mixed), F.lit(16))), (*named, *bare), " "),
        ("git key", 1, F.concat(F.lit("ghp_"), F.left(mixed, F.lit(36))), (*named, *bare), " "),
        ("pay key", 1, F.concat(F.lit("sk_live_"), F.left(mixed, F.lit(24))), (*named, *bare), " "),
        ("chat key", 1, F.concat(F.lit("xoxb-"), F.left(digits, F.lit(12)), F.lit("-"), F.left(mixed, F.lit(24))), (*named, *bare), " "),
        ("map key", 1, F.concat(F.lit("AIza"), F.left(mixed, F.lit(35))), (*named, *bare), " "),
        ("bearer", 1, F.left(mixed, F.lit(64)), ("Authorization: Bearer ", "auth: ", "access_token="), " "),
        ("password", 1, F.concat(F.initcap(F.left(word(0), F.lit(4))), F.lit("!"), F.left(mixed, F.lit(5))), ('password = "', "passwd: ", "pwd=", "login://root:"), '"'),
        ("commit", 0, F.left(hexes, F.lit(40)), ("commit ", "revision ", "at ", "blob "), " "),
        ("digest", 0, hexes, ("sha256 ", "digest ", "checksum: ", "hash "), " "),
        ("record id", 0, F.concat_ws("-", *[F.substring(hexes, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), ("id: ", "record ", "row ", "trace "), " "),
        ("order number", 0, F.left(digits, F.lit(16)), ("order ", "no. ", "account ", "ref: "), " "),
        ("long word", 0, F.upper(F.concat(*[word(i) for i in range(5)])), bare, " "),
        ("camel case", 0, F.concat(word(0), *[F.initcap(word(i)) for i in range(1, 4)]), ("call ", "the ", "see "), "()"),
        ("path", 0, F.concat(word(0), F.lit("/"), word(1), F.lit("2/"), word(2), F.lit("_"), word(3)), ("in ", "open ", "file: "), " "),
        ("named word", 0, F.concat(word(0), F.left(word(1), F.lit(4))), ("password: ", "the token: ", "secret = "), " "),
        ("example", 0, F.left(hexes, F.lit(40)), ('example_token = "', 'testToken = "', 'MOCK_SECRET: "', 'dummy_api_key = "'), '"'),
        ("placeholder", 0, F.concat(F.lit("example-"), F.left(mixed, F.lit(12))), named, '"'),
    ]


def planted_findings(docs: DataFrame, *, max_texts: int = MAX_TEXTS) -> DataFrame:
    """value, left, right, path, label, family: one finding of every family in each of at most `max_texts` different texts, by hash.

    The words around it, and those that look-alikes are made of, are a stretch of the text; texts of fewer than 5 words are not used.
    """
    text = F.col("text")
    h = F.xxhash64("text", F.lit("planted"))
    some = F.pmod(h, F.lit(max(1, docs.count() // (8 * max_texts)))) == 0  # several times what is taken, so that few rows are ordered
    at = F.pmod(h, F.greatest(F.length(text) - 2 * NEIGHBOUR_CHARS, F.lit(1))).cast("int") + 1
    around = docs.where(F.col("text").isNotNull() & some).select(h.alias("n"), F.substring(text, at, F.lit(2 * NEIGHBOUR_CHARS)).alias("around"))
    around = around.withColumn("words", F.regexp_extract_all("around", F.lit(r"\p{L}{3,}"), F.lit(0))).where(F.size("words") >= 5)
    around = staged(around.distinct().orderBy("n", "around").limit(max_texts), "around").withColumn("h", F.hex("n"))
    paths = F.array(*[F.lit(x) for x in ("", "src/app.py", "conf/prod.env", "docs/notes.md")])
    rows = []
    for k, (name, label, value, before, after) in enumerate(_families()):
        pick = F.get(F.array(*[F.lit(b) for b in before]), F.pmod(F.xxhash64("n", F.lit(k)), F.lit(len(before))).cast("int"))
        left = F.right(F.concat(F.left("around", F.lit(NEIGHBOUR_CHARS)), F.lit(" "), pick), F.lit(NEIGHBOUR_CHARS))
        right = F.left(F.concat(F.lit(after), F.right("around", F.lit(NEIGHBOUR_CHARS))), F.lit(NEIGHBOUR_CHARS))
        rows.append(F.struct(value.alias("value"), left.alias("left"), right.alias("right"), F.lit(float(label)).alias("label"), F.lit(name).alias("family")))
    each = around.select(F.get(paths, F.pmod("n", F.lit(4)).cast("int")).alias("path"), F.inline(F.array(*rows)))
    return each.select("value", "left", "right", "path", "label", "family")


def train_forest(labelled: DataFrame, *, max_rows: int = MAX_ROWS, trees: int = 24, depth: int = 6) -> Model | None:
    """A forest from rows with the columns of FEATURES and label; None when only one label, or none, is there.

    At most `max_rows` rows of each label are taken, by hash; equal rows count once.
    """
    rows = labelled.where("label is not null").select("label", *FEATURES).distinct().withColumn("_h", F.xxhash64(*FEATURES))
    parts = [rows.where(F.col("label") == y).orderBy("_h").limit(max_rows) for y in (0.0, 1.0)]
    sample = staged(parts[0].unionByName(parts[1]), "findings")
    if sample.select("label").distinct().count() < 2:
        return None
    # the same rows in the same order, however the table was written
    ordered = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample.repartition(4, "_h").sortWithinPartitions("_h"))
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=7)
    return forest.fit(ordered)


def with_probability(found: DataFrame, model: Model | None) -> DataFrame:
    """`found` (with the columns of FEATURES) and probability; 1 without a model."""
    if model is None:
        return found.withColumn("probability", F.lit(1.0))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found)
    return model.transform(vectors).withColumn("probability", vector_to_array("probability")[1])


def scan_secrets(docs: DataFrame, *, findings: DataFrame | None = None, path: str = "source", threshold: float = 0.5) -> DataFrame:
    """doc_id, nth, value, probability, is_secret: a row for every candidate in every row of `docs`.

    `findings` has labelled rows (value, left, right, path, label); without it they are planted, see `planted_findings`.
    When there are not both labels nothing can be told apart, and every candidate stays, with probability 1. Null and empty
    texts have no candidates; repeated rows give repeated findings; a null path is an empty one. Extra columns are not read.
    """
    words = staged(dictionary(docs), "dictionary")
    logs = transition_logs(words)
    found = staged(candidates(docs, path=path), "candidates")  # few beside the texts, which are searched once
    known = planted_findings(docs) if findings is None else findings
    model = train_forest(with_features(known.select("value", "left", "right", "path", "label"), words, logs))
    scored = with_probability(with_features(found, words, logs), model)
    return scored.select("doc_id", "nth", "value", F.col("probability"), (F.col("probability") >= threshold).alias("is_secret"))


def op1_secrets(spark, sf_dir):
    """Findings with the value itself withheld: its hash and length stand for it."""
    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "nth", F.sha2("value", 256).alias("value_sha256"), F.length("value").alias("length"), "probability", "is_secret")


QUERIES = {"op1_secrets": op1_secrets}
ORACLES: dict[str, str] = {}
