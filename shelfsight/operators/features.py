"""Normalised features of items, labels, sales, revenue and complexity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import payloads as P
from ..functions import text as T
from ..params import FeatureParams
from ..sources.scratch import written
from .quantiles import quantile_row

LOGGED = ("size_bytes", "ram_bytes", "early_access_days", "maker_titles", "achievement_count", "addon_count", "language_count")
FEATURES = (*LOGGED, "simple_label_score", "complex_label_score", "platform_count")


def normalize_items(catalog: DataFrame, details: DataFrame, reviews: DataFrame, label_source: DataFrame, params: FeatureParams) -> DataFrame:
    """One typed row for every catalog item, with or without details.

    catalog: see `build_catalog`; the others: item_id, payload. An item is in scope when its details succeeded,
    it is a game, it is in the label source and none of its genres is software. Payloads are spread by item before they are parsed: parsing costs
    far more than their bytes tell, and a file may be one task. A filter on the result is pushed below the parsing, and parses once for every field it names: write it first.
    """
    details, reviews = (p.repartition("item_id") for p in (details, reviews))
    inner = details.select("item_id", P.inner_object(F.col("payload"), F.col("item_id")).alias("_inner"))
    d = inner.select("item_id", P.typed(F.col("_inner"), P.DETAIL).alias("d"), P.handheld_category(F.col("_inner"), params.handheld_key_ending).alias("_handheld"))
    r = reviews.select("item_id", P.typed(F.try_parse_json("payload"), P.REVIEWS).alias("r"))
    known = label_source.select("item_id").distinct().withColumn("labelled", F.lit(True))
    joined = catalog.join(d, "item_id", "left").join(r, "item_id", "left").join(known, "item_id", "left")
    ok = F.coalesce(F.col("d.success"), F.lit(False))
    x = lambda c: F.when(ok, F.col(f"d.data.{c}"))
    genres = P.names_of(x("genres"))
    reviewed = F.coalesce(F.col("r.success") == 1, F.lit(False))
    total, pos, neg = F.col("r.query_summary.total_reviews"), F.col("positive"), F.col("negative")
    count = P.review_count(total, reviewed, pos, neg)
    positive = F.when(reviewed & total.isNotNull(), F.col("r.query_summary.total_positive")).otherwise(pos)
    needs = (F.col("d.data.pc_requirements.minimum"), F.col("d.data.pc_requirements.recommended"))
    size, ram = F.when(ok, T.storage_bytes(*needs)), F.when(ok, T.memory_bytes(*needs))
    early = P.early_access(x("genres"))
    typed = joined.select(
        "item_id",
        F.coalesce(F.nullif(x("name"), F.lit("")), "name").alias("name"),
        x("type").alias("item_type"),
        P.first_or(x("developers"), F.col("maker")).alias("maker"),
        P.first_or(x("publishers"), F.col("publisher")).alias("publisher"),
        (ok & F.coalesce(x("type") == "game", F.lit(False)) & F.coalesce("labelled", F.lit(False)) & ~P.any_of(genres, params.software_genres)).alias("in_scope"),
        P.any_of(genres, params.software_genres).alias("is_software"),
        F.coalesce("labelled", F.lit(False)).alias("is_listed"),
        (x("price_overview.final") / 100).alias("price"),
        x("is_free").alias("is_free"),
        count.alias("review_count"),
        P.review_source(total, reviewed, pos, neg).alias("review_source"),
        P.positive_share(positive, count).alias("positive_share"),
        "owners_low", "owners_high",
        size.alias("size_bytes"),
        ram.alias("ram_bytes"),
        P.whole_count(x("achievements.total")).alias("achievement_count"),
        P.language_count(x("supported_languages")).alias("language_count"),
        P.platform_count(x("platforms")).alias("platform_count"),
        F.when(ok, F.coalesce(F.size(x("dlc")), F.lit(0))).alias("addon_count"),
        early.alias("is_early_access"),
        F.lit(None).cast("int").alias("early_access_days"),
        F.when(ok, F.col("_handheld")).alias("handheld"),
        T.lenient_date(x("release_date.date")).alias("released"),
        genres.alias("genres"),
        P.names_of(x("categories")).alias("categories"),
    )
    watched = ("price", "review_count", "size_bytes", "ram_bytes", "achievement_count", "language_count", "platform_count")
    return typed.withColumn("missing", P.missing_names(**{c: F.col(c) for c in watched}))


def software_ids(details: DataFrame, genres: tuple[str, ...]) -> DataFrame:
    """Ids of items with any genre in `genres`; details: item_id, genres."""
    return details.where(P.any_of(F.col("genres"), genres)).select("item_id").distinct()


def extract_labels(source: DataFrame, params: FeatureParams) -> DataFrame:
    """(item_id, labels map) -> item_id, label, votes, rank: most votes first, then by name, `max_labels` at most."""
    each = source.select("item_id", F.explode("labels").alias("label", "votes")).where(F.coalesce("votes", F.lit(0)) >= params.min_votes)
    return rank_labels(each, params.max_labels)


def rank_labels(labels: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.col("votes").desc(), "label")
    return labels.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def label_scores(labels: DataFrame, vocabularies: dict[str, tuple[str, ...]]) -> DataFrame:
    """item_id and, for each name, the share of the item's labels that are in its vocabulary, whatever their case; items without labels are absent."""
    hit = lambda words: F.lower("label").isin([v.lower() for v in words]).cast("double")
    return labels.groupBy("item_id").agg(*[F.avg(hit(words)).alias(name) for name, words in vocabularies.items()])


def label_score(labels: DataFrame, vocabulary: tuple[str, ...], out: str) -> DataFrame:
    return label_scores(labels, {out: vocabulary})


def maker_titles(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """`items` with maker_titles, the maker's other titles in the catalog; an empty or null maker has none."""
    named = F.nullif("maker", F.lit(""))
    counts = catalog.groupBy(named.alias("_maker")).agg(F.count("*").alias("_n")).where("_maker is not null")
    joined = items.join(counts, named == F.col("_maker"), "left")
    return joined.withColumn("maker_titles", F.greatest(F.coalesce("_n", F.lit(1)) - 1, F.lit(0)).cast("long")).drop("_maker", "_n")


def genre_bucket(params: FeatureParams) -> Column:
    """Bucket of the first listed genre that has one, else the default."""
    if not params.genre_buckets:
        return F.lit(params.default_bucket)
    buckets = F.create_map(*[F.lit(x) for pair in params.genre_buckets.items() for x in pair])
    known = F.filter(F.transform("genres", lambda g: F.try_element_at(buckets, g)), lambda b: b.isNotNull())
    return F.coalesce(F.get(known, 0), F.lit(params.default_bucket))


def with_sales(items: DataFrame, params: FeatureParams) -> DataFrame:
    """bucket, sales_low, sales_mid, sales_high: reviews times the bucket's multiples; a bucket without any is an error."""
    out = items.withColumn("bucket", genre_bucket(params))
    for k, name in enumerate(("sales_low", "sales_mid", "sales_high")):
        multiples = F.create_map(*[F.lit(x) for b, band in params.sales_per_review.items() for x in (b, band[k])])
        multiple = F.coalesce(F.try_element_at(multiples, "bucket"), F.raise_error(F.concat(F.lit("no sales band for bucket "), "bucket")).cast("double"))
        out = out.withColumn(name, F.col("review_count") * multiple)
    return out


def with_revenue(items: DataFrame, params: FeatureParams) -> DataFrame:
    """revenue_gross and revenue_net; null where price is 0 or unknown."""
    gross = F.when(F.col("price") != 0, F.col("sales_mid") * F.col("price"))
    kept = (1 - params.storefront_cut) * (1 - params.discount) * (1 - params.refunds)
    return items.withColumn("revenue_gross", gross).withColumn("revenue_net", F.col("revenue_gross") * kept)


def log_scaled(x: Column, low: float, high: float) -> Column:
    """log10(x + 1) between the bounds, cut to [0, 1]; null below 0 or without a span."""
    if low == high:
        return F.lit(None).cast("double")
    return F.when(x >= 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.log10(x + 1) - low) / (high - low))))


def _raw(name: str) -> Column:
    if name == "early_access_days":
        return F.when(F.coalesce("is_early_access", F.lit(False)), F.col(name)).otherwise(F.lit(0))
    return F.col(name)


def complexity(items: DataFrame, labels: DataFrame, params: FeatureParams) -> DataFrame:
    """`items` with complexity, contributions (struct) and imputed (names).

    A normalised feature that is null gets the cohort's median, or 0.5 where all are null, and then is not
    named as imputed. The platform count is never imputed, so without it there is no score; nor is there
    one when more than `most_missing` of the features were missing. The normalised items are written once, their exact
    medians are found by two aggregations over them, and are one row that is joined to every item.
    """
    shares = label_scores(labels, {"simple_label_score": params.simple_labels, "complex_label_score": params.complex_labels})
    scored = items.join(shares, "item_id", "left")
    normal = {f: log_scaled(_raw(f).cast("double"), *params.bounds[f]) if f in params.bounds else F.lit(None).cast("double") for f in LOGGED}
    normal |= {
        "simple_label_score": 1 - F.col("simple_label_score"),
        "complex_label_score": F.col("complex_label_score"),
        "platform_count": (F.col("platform_count") - 1) / 2,
    }
    scaled = written(scored.withColumns({f"_n_{f}": c.cast("double") for f, c in normal.items()}), "scaled")
    filled = [f for f in FEATURES if f != "platform_count"]
    medians = quantile_row(scaled, {f: F.col(f"_n_{f}") for f in filled}, [0.5], stored=True).select(*[F.col(f)[0].alias(f"_m_{f}") for f in filled])
    both = scaled.crossJoin(F.broadcast(medians))  # one row
    value = {f: F.coalesce(f"_n_{f}", f"_m_{f}", F.lit(0.5)) for f in filled} | {"platform_count": F.col("_n_platform_count")}
    part = {f: value[f] * params.weights[f] for f in FEATURES}
    absent = {f: _raw(f).isNull() & (F.col(f"_m_{f}").isNotNull() if f in filled else F.lit(True)) for f in FEATURES}
    n_absent = sum((absent[f].cast("int") for f in FEATURES), F.lit(0))
    total = sum((part[f] for f in FEATURES), F.lit(0.0))
    score = F.when(n_absent / len(FEATURES) <= params.most_missing, F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))
    score = F.when(F.col("_n_platform_count").isNotNull(), score)
    out = both.withColumn("complexity", score)
    out = out.withColumn("contributions", F.struct(*[part[f].alias(f) for f in FEATURES]))
    out = out.withColumn("imputed", F.array_compact(F.array(*[F.when(absent[f], F.lit(f)) for f in FEATURES])))
    return out.drop(*[f"_n_{f}" for f in FEATURES], *[f"_m_{f}" for f in filled])


def with_return(items: DataFrame, params: FeatureParams) -> DataFrame:
    return items.withColumn("effort_return", F.col("revenue_net") / (F.col("complexity") + params.epsilon))


def frozen_bounds(items: DataFrame, *, least_rows: int = 30) -> DataFrame:
    """feature, low, high, n: 5th and 95th percentiles of log10(x + 1), and the known values of each log feature in `items`.

    A feature without a known value is left out: it stays unfrozen. Fewer than `least_rows` rows, and a feature whose bounds are
    equal, are errors when the result is read.
    """
    cols = [c for c in LOGGED if c in items.columns]
    known = {c: F.when(F.col(c) >= 0, F.col(c)) for c in cols}
    bounds = quantile_row(items, {c: F.log10(x + 1) for c, x in known.items()}, [0.05, 0.95])
    sizes = items.agg(F.count("*").alias("n_rows"), *[F.count(x).alias(f"n_{c}") for c, x in known.items()])
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c)[0].alias("low"), F.col(c)[1].alias("high"), F.col(f"n_{c}").alias("n")) for c in cols]))
    rows = bounds.join(sizes).select("n_rows", each).where("n > 0 or n_rows < " + str(least_rows))  # one row beside one row
    few = F.raise_error(F.concat(F.lit("too few rows to freeze bounds: "), F.col("n_rows").cast("string"))).cast("double")
    flat = F.raise_error(F.concat(F.lit("no span between the bounds of "), "feature")).cast("double")
    low = F.when(F.col("n_rows") < least_rows, few).when(F.abs(F.col("high") - F.col("low")) <= 1e-8 + 1e-5 * F.abs("high"), flat).otherwise(F.col("low"))
    return rows.select("feature", low.alias("low"), "high", "n")


def drop_reasons(normal: DataFrame) -> DataFrame:
    """One row: kept, software_genre, other_type - why normalised items are out of scope.

    Software: typed as a game and listed in the label source, but with a software genre; all others that are out count as of another type.
    """
    software = F.col("is_software") & F.coalesce(F.col("item_type") == "game", F.lit(False)) & F.col("is_listed")
    out = ~F.col("in_scope")
    return normal.agg(F.count_if("in_scope").alias("kept"), F.count_if(out & software).alias("software_genre"), F.count_if(out & ~software).alias("other_type"))


def enrichment_report(items: DataFrame) -> DataFrame:
    """One row: rows, out_of_scope, free, unknown_price, first_genre_unmatched and the imputation rate of every feature.

    `items`: with complexity, in_scope, first_genre_known."""
    rates = [F.avg(F.array_contains("imputed", f).cast("double")).alias(f"imputed_{f}") for f in FEATURES]
    return items.agg(
        F.count("*").alias("n_rows"), F.count_if(~F.col("in_scope")).alias("out_of_scope"), F.count_if(F.col("price") == 0).alias("free"),
        F.count_if(F.col("price").isNull()).alias("unknown_price"), F.count_if(~F.col("first_genre_known")).alias("first_genre_unmatched"), *rates,
    )
