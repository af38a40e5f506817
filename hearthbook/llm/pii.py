"""Personal data: candidate spans, boosted trees, calibrated thresholds.

Four base patterns find what is personal data by its form; each match is checked (octets,
check digit, number of digits). Wider patterns propose further, overlapping spans: numbers
in any grouping, and addresses with their signs spelt out. Boosted trees then judge every
proposal from its format and its context. They learn from the checked base spans, and from
the same spans with their signs masked (no plus sign, the at sign spelt out), against
proposals that fail a check. Any other proposal has no label: it may be what is looked for,
however common that is. For each kind a threshold is calibrated on documents that weren't
used for training; proposals above it that overlap no base span are added. Base spans
always stay.

Everything is DataFrame operations and Spark's own GBTClassifier; no Python runs in tasks.
Positions are code points. Java's matcher keeps its place between matches, so `\\G` marks the
end of the last one: a match may start there or at the start of a run, which gives the
same matches as the plain patterns without trying every place of a long run.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from hearthbook.llm.common import spare_name, text_of, written

# Kinds in the order of output, and their patterns.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
NUMBER, SPELT = 4, 5
PROPOSALS = (
    r"(?:\G|(?<![0-9]))(?:\+|\()?[0-9][0-9().\x20/-]{5,38}[0-9](?![0-9])",
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]{1,64}+(?:\x20?[(\[]at[)\]]\x20?|\x20at\x20|@)"
    r"[A-Za-z0-9-]{1,64}+(?:(?:\x20?[(\[]dot[)\]]\x20?|\x20dot\x20|\.)[A-Za-z]{2,24}+)++",
)
#: What a text must contain for a pattern to be tried at all.
SIGNS = ("@", ".", None, "+", None, None)
DOTS = r"[.]|\x20dot\x20|[(\[]dot[)\]]"

#: Candidates of each label, those with the smallest hashes, that the trees are fitted on.
TRAIN_ROWS = 10_000
CALIBRATION_FOLDS = 5
PRECISION = 0.98
BINS = 100
FEATURES = (
    "length", "digits", "letters", "groups", "longest_group", "first_group", "last_group", "dots", "dashes",
    "blanks", "brackets", "other", "is_number", "label_before", "letter_before", "letter_after", "quote_before",
    "digit_before", "digit_after", "luhn", "octets",
)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right: from the right, every second digit counts twice."""
    places = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(
            F.filter(places, lambda d: d != ""),
            lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
                F.element_at(F.array(*[F.lit(sum(divmod(2 * x, 10))) for x in range(10)]), d.cast("int") + 1)
            ),
        ),
        F.lit(0), lambda a, b: a + b,
    )
    return (F.length(digits) > 0) & (total % 10 == 0)


def _octets(text: Column) -> Column:
    return F.forall(
        F.split(text, r"\."),
        lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).cast("int"), F.lit(0)) <= 255),
    )


def _holds(kind: int, piece: Column) -> Column:
    """Whether a match of a base pattern is that kind of data."""
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return _octets(piece)
    count = F.length(_digits(piece))
    if kind == 2:
        return F.when(count.between(16, 19), _luhn(_digits(piece))).otherwise(False)
    return count.between(8, 15)


def matches(docs: DataFrame) -> DataFrame:
    """A row for every match of every pattern, and one with a null kind for a row without any.

    row_id tells the rows of docs apart, repeated ones too. first and beyond are the span;
    piece (cut to 80 characters), before and after are what the trees look at; valid is
    set for base matches that pass their check. Null texts count as empty.
    """
    found = []
    for kind, (pattern, sign) in enumerate(zip((*PATTERNS, *PROPOSALS), SIGNS, strict=True)):
        rule = F.lit(pattern)
        whole = F.col("text") if sign is None else F.when(F.contains("text", F.lit(sign)), F.col("text")).otherwise("")
        found.append((kind, F.regexp_extract_all(whole, rule, F.lit(0)), F.split(whole, pattern, -1)))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"),
        text_of().alias("text"),
    )
    rows = rows.select(
        "row_id", "doc_id", F.xxhash64("text").alias("text_hash"),
        *[c.alias(f"{n}{k}") for k, m, g in found for c, n in ((m, "m"), (g, "g"))],
    )

    def each(kind: int) -> Column:
        gaps = F.col(f"g{kind}")
        return F.transform(
            f"m{kind}",
            lambda x, i: F.struct(
                F.lit(kind).alias("kind"), i.alias("at"), F.char_length(F.get(gaps, i)).alias("gap"),
                F.char_length(x).alias("len"), F.left(x, F.lit(80)).alias("piece"),
                F.right(F.get(gaps, i), F.lit(24)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(8)).alias("after"),
                (_holds(kind, x) if kind < NUMBER else F.lit(False)).alias("valid"),
            ),
        )

    rows = rows.select("row_id", "doc_id", "text_hash", F.explode_outer(F.concat(*[each(k) for k, _, _ in found])).alias("m"))
    in_order = Window.partitionBy("row_id", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.select("row_id", "doc_id", "text_hash", "m.*")
        .withColumn("beyond", F.sum(F.col("gap") + F.col("len")).over(in_order))
        .select("row_id", "doc_id", "text_hash", "kind", (F.col("beyond") - F.col("len")).alias("first"), "beyond",
                "piece", "before", "after", "valid")
    )


def featured(rows: DataFrame) -> DataFrame:
    """rows with the numbers that the trees use, none of them null."""
    piece, before = F.col("piece"), F.col("before")
    groups = F.filter(F.split(piece, "[^0-9]+"), lambda g: g != "")
    count = lambda pattern: F.length(piece) - F.length(F.regexp_replace(piece, pattern, ""))
    made = {
        "length": F.length(piece), "digits": count("[0-9]"), "letters": count("[A-Za-z]"), "groups": F.size(groups),
        "longest_group": F.array_max(F.transform(groups, F.length)), "first_group": F.length(F.get(groups, F.lit(0))),
        "last_group": F.length(F.element_at(F.concat(F.array(F.lit("")), groups), -1)),
        "dots": F.size(F.split(piece, DOTS)) - 1, "dashes": count("-"), "blanks": count(" "),
        "brackets": count(r"[()\[\]]"), "other": count("[/_%]"), "is_number": (F.col("kind") == NUMBER),
        "label_before": F.lower(before).rlike(r"(?:tel|phone|fon|call|fax|mobile|mail|card|ip|contact)[.:\x20]{0,3}$"),
        "letter_before": before.rlike(r"\p{L}$"), "letter_after": F.col("after").rlike(r"^\p{L}"),
        "quote_before": before.rlike("[\"'=#][^\\x20]*$"), "digit_before": before.rlike("[0-9][^\\x20]*$"),
        "digit_after": F.col("after").rlike("^[^\\x20]?[0-9]"),
        "luhn": F.when(count("[0-9]").between(16, 19), _luhn(_digits(piece))),
        "octets": F.when(piece.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), _octets(piece)),
    }
    return rows.withColumns({name: F.coalesce(made[name].cast("double"), F.lit(0.0)) for name in FEATURES})


def proposals(found: DataFrame) -> DataFrame:
    """The proposed spans with their features, whether they overlap a base span, and a label.

    label 1: the proposal is a checked base span, or holds one and only a sign more; 0: it
    overlaps none and fails a check. All others have no label. Where base spans lie is found
    by one ordered pass over the spans of a row.
    """
    base = F.col("valid") & (F.col("kind") < NUMBER)
    spans = found.where(F.col("kind").isNotNull() & (base | (F.col("kind") >= NUMBER)))
    earlier = Window.partitionBy("row_id").orderBy("first", "beyond").rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("row_id").orderBy("first", "beyond").rowsBetween(0, Window.unboundedFollowing)
    spans = spans.select(
        "*",
        F.max(F.when(base, F.col("beyond"))).over(earlier).alias("base_beyond"),
        F.max(F.when(base, F.col("first"))).over(earlier).alias("base_first"),
        F.min(F.when(base, F.col("first"))).over(later).alias("next_first"),
        F.min(F.when(base, F.struct("first", "beyond"))).over(later)["beyond"].alias("next_beyond"),
    ).where(F.col("kind") >= NUMBER)
    first, beyond = F.col("first"), F.col("beyond")
    overlaps = F.coalesce((F.col("base_beyond") > first), F.lit(False)) | F.coalesce(F.col("next_first") < beyond, F.lit(False))
    alike = lambda a, b: (F.abs(a - first) <= 1) & (F.abs(b - beyond) <= 1)
    same = F.coalesce(alike(F.col("base_first"), F.col("base_beyond")), F.lit(False)) | F.coalesce(
        alike(F.col("next_first"), F.col("next_beyond")), F.lit(False)
    )
    return featured(
        spans.withColumn("overlaps", overlaps).withColumn("same", same)
        .drop("base_beyond", "base_first", "next_first", "next_beyond")
    ).withColumn("label", F.when(F.col("same"), 1.0).when(~F.col("overlaps") & fails(), 0.0)).drop("same").withColumn(
        "fold", F.pmod("text_hash", F.lit(CALIBRATION_FOLDS))
    )


def fails() -> Column:
    """Whether a featured proposal can't be personal data by its form.

    Numbers: inside a word such as a hex token, 16 to 19 digits without a right check digit,
    four dotted groups that are no octets, a date. Addresses: misplaced dots or dashes, an
    ending in mixed case ("home.Then"), or a plain word, "at" and a name with dots, which is
    prose or a web address.
    """
    piece = F.col("piece")
    number = (
        (((F.col("letter_before") == 1) & (F.col("label_before") == 0)) | (F.col("letter_after") == 1))
        | (F.col("digits").between(16, 19) & (F.col("luhn") == 0))
        | (piece.rlike(r"^[0-9]+(?:\.[0-9]+){3}$") & (F.col("octets") == 0))
        | piece.rlike(r"^(?:19|20)[0-9]{2}[-./](?:0?[1-9]|1[0-2])[-./](?:0?[1-9]|[12][0-9]|3[01])(?:\x20[0-9]{1,2})?$")
    )
    spelt = (
        piece.rlike(r"^[.]|[.]{2}|^[^@\x20(\[]*[.](?:@|\x20|[(\[])")
        | piece.rlike(r"(?:@|\x20|[)\].])-|-(?:[.\x20]|[(\[]dot)")
        | piece.rlike(r"[A-Z][a-z]+$|[a-z][A-Z]+$")
        | piece.rlike(r"^[a-z]+\x20at\x20[A-Za-z0-9-]+(?:\.[A-Za-z]+)+$")
    )
    return F.when(F.col("kind") == NUMBER, number).otherwise(spelt)


def masked(proposed: DataFrame) -> DataFrame:
    """What true proposals look like without the signs of their base pattern, one row for each way."""
    true = proposed.where("label = 1").drop(*FEATURES)
    piece = F.col("piece")
    host = F.substring_index(piece, "@", -1)
    spelt = [
        F.concat(F.substring_index(piece, "@", 1), F.lit(at), F.replace(host, F.lit("."), F.lit(dot)))
        for at, dot in ((" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("[at]", "."), (" (at) ", "."))
    ]
    ways = F.when((F.col("kind") == SPELT) & F.contains(piece, F.lit("@")), F.array(*spelt)).when(
        (F.col("kind") == NUMBER) & F.startswith(piece, F.lit("+")), F.array(F.substring(piece, 2, 80))
    )
    made = true.withColumn("piece", F.explode(ways))
    return featured(made).select(*proposed.columns)


def kind_of_proposal() -> Column:
    """Which kind a proposal would be added as."""
    digits = F.col("digits")
    return (
        F.when(F.col("kind") == SPELT, F.lit(0))
        .when((F.col("octets") == 1) & (F.col("dots") == 3), 1)
        .when(digits.between(16, 19), 2)
        .when(digits.between(8, 15), 3)
    )


def fit(proposed: DataFrame, rows: int = TRAIN_ROWS) -> GBTClassificationModel | None:
    """The trees, from up to `rows` proposals of each label; None where a label has none.

    Of each label those with the smallest hashes of place and text are taken: a bounded
    sample, the same on every run. Documents of fold 0 are kept for calibration.
    """
    known = proposed.where("label IS NOT NULL AND fold != 0").select(
        "label", *FEATURES, F.xxhash64("text_hash", "first", "kind", "piece").alias("order")
    )
    taken = [known.where(F.col("label") == label).orderBy("order", "first_group").limit(rows) for label in (0.0, 1.0)]
    sample = written(taken[0].unionByName(taken[1]), "pii-sample").orderBy("order", "label").coalesce(1)
    if sample.select("label").distinct().count() < 2:
        return None
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample)
    return GBTClassifier(maxIter=10, maxDepth=4, seed=7, cacheNodeIds=False).fit(vectors.select("label", "features"))


def judged(proposed: DataFrame, model: GBTClassificationModel) -> DataFrame:
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(proposed)
    chance = F.get(vector_to_array("probability"), F.lit(1))
    return model.transform(vectors).select(*proposed.columns, chance.alias("chance"), kind_of_proposal().alias("as_kind"))


def thresholds(scored: DataFrame) -> dict[int, float]:
    """By kind, the lowest chance, 0.5 at least, from which the labelled proposals of fold 0 are PRECISION true.

    It is read from BINS counts per kind over all of that fold. A kind without a true
    proposal there, or that never gets so precise, has no threshold and nothing is added.
    """
    counts = (
        scored.where("fold = 0 AND label IS NOT NULL AND as_kind IS NOT NULL")
        .groupBy("as_kind", F.least(F.floor(F.col("chance") * BINS), F.lit(BINS - 1)).alias("bin"))
        .agg(F.sum("label").alias("true"), F.count("*").alias("all")).collect()
    )
    out = {}
    for kind in range(len(KINDS)):
        true = seen = 0.0
        for row in sorted((r for r in counts if r["as_kind"] == kind), key=lambda r: -r["bin"]):
            if row["bin"] < BINS // 2:
                break
            true, seen = true + row["true"], seen + row["all"]
            if true and true / seen >= PRECISION:
                out[kind] = row["bin"] / BINS
    return out


def spans(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(row_id, doc_id, text_hash, kind, first, beyond, base): the personal data of every text.

    kind is an index of KINDS. A row without any has one row with a null kind. Added spans
    overlap neither base spans nor each other.
    """
    found = written(matches(docs), "pii-matches")
    base = found.where("kind IS NULL OR (valid AND kind < 4)")
    empty = found.groupBy("row_id", "doc_id", "text_hash").agg(F.lit(None).cast("int").alias("kind"))
    keep = ["row_id", "doc_id", "text_hash", "kind", "first", "beyond"]
    out = base.where("kind IS NOT NULL").select(*keep, F.lit(True).alias("base"))
    nothing = empty.select(*keep[:4], F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("beyond"), F.lit(True).alias("base"))
    proposed = proposals(found)
    proposed = proposed.unionByName(masked(proposed))  # these overlap base spans, so they are never added
    model = fit(proposed, train_rows)
    if model is not None:
        scored = judged(proposed, model)
        least = thresholds(scored)
        if least:
            enough = F.lit(False)
            for kind, chance in least.items():
                enough = enough | ((F.col("as_kind") == kind) & (F.col("chance") >= chance))
            taken = scored.where(~F.col("overlaps") & enough)
            in_order = Window.partitionBy("row_id").orderBy("first", "beyond", "as_kind")
            before = in_order.rowsBetween(Window.unboundedPreceding, -1)
            apart = taken.withColumn("reach", F.max("beyond").over(before))
            apart = apart.where(F.col("reach").isNull() | (F.col("reach") <= F.col("first")))
            out = out.union(apart.select(*keep[:3], F.col("as_kind").alias("kind"), "first", "beyond", F.lit(False)))
    return out.union(nothing)


def listed(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """A row for each row of docs: counts, digest and lists of its spans."""
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("s.kind") + 1)
    text = lambda x: F.concat_ws(
        ":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["first"].cast("string"), x["beyond"].cast("string")
    )
    del name
    one = F.struct("kind", "first", "beyond")
    valid = F.col("kind").isNotNull()
    grouped = spans(docs, train_rows).groupBy("row_id", "doc_id").agg(
        *[F.count(F.when((F.col("kind") == k) & F.col("base"), 1)).alias(f"n_{n}") for k, n in enumerate(KINDS)],
        F.count(F.when(~F.col("base"), 1)).alias("n_added"),
        F.array_sort(F.collect_list(F.when(valid & F.col("base"), one))).alias("base_spans"),
        F.array_sort(F.collect_list(F.when(valid, one))).alias("all_spans"),
    )
    return grouped.select(
        "doc_id", *[f"n_{n}" for n in KINDS],
        F.sha2(F.array_join(F.transform("base_spans", text), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("all_spans", text), ",").alias("spans"), "n_added",
    )


def redacted(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """docs with every span replaced by its kind in brackets, and n_chars counted anew.

    Overlapping spans become one, named by the first. Rows without spans stay as they are.
    """
    one = F.struct("first", "beyond", "kind")
    span_id, span_hash, own_spans, own_merged, own_hash = (
        spare_name(docs, c) for c in ("span_id", "span_hash", "own_spans", "own_merged", "own_hash")
    )
    found = (
        spans(docs, train_rows).where("kind IS NOT NULL")
        .groupBy(F.col("doc_id").alias(span_id), F.col("text_hash").alias(span_hash))
        .agg(F.array_sort(F.collect_set(one)).alias(own_spans))
    )
    # Union of overlapping spans, then the text between them; spans are few next to a text.
    merged = F.aggregate(
        own_spans, F.array().cast("array<struct<first:bigint,beyond:bigint,kind:int>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["beyond"] > s["first"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(
                    F.element_at(done, -1)["first"].alias("first"),
                    F.greatest(F.element_at(done, -1)["beyond"], s["beyond"]).alias("beyond"),
                    F.element_at(done, -1)["kind"].alias("kind"),
                )),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    cut = lambda a, n: F.substring(F.col("text"), (a + 1).cast("int"), n.cast("int"))
    pieces = F.transform(
        own_merged,
        lambda s, i: F.concat(
            cut(
                F.when(i == 0, F.lit(0)).otherwise(F.get(F.col(own_merged), i - 1)["beyond"]),
                s["first"] - F.when(i == 0, F.lit(0)).otherwise(F.get(F.col(own_merged), i - 1)["beyond"]),
            ),
            F.element_at(tags, s["kind"] + 1),
        ),
    )
    tail = F.element_at(F.col(own_merged), -1)["beyond"]
    text = F.when(
        F.col(own_merged).isNotNull(),
        F.concat(F.array_join(pieces, ""), cut(tail, F.char_length("text") - tail)),
    ).otherwise(F.col("text"))
    rows = docs.withColumn(own_hash, F.xxhash64(text_of()))
    joined = rows.join(
        found,
        F.col("doc_id").cast("long").eqNullSafe(F.col(span_id)) & (F.col(own_hash) == F.col(span_hash)),
        "left",
    ).withColumn(own_merged, F.when(F.col(own_spans).isNotNull(), merged))
    changed = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = changed.withColumn(
            "n_chars", F.when(F.col(own_merged).isNotNull(), F.char_length("text").cast(kind)).otherwise(F.col("n_chars"))
        )
    return changed.select(*docs.columns)
