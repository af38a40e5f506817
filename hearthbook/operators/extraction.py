"""Reading bills from text: provider, amount, due date, frequency and kind.

Every value found is a *suggestion* with source ``billExtraction``. The work is a
chain of projections over the document table: whole texts, native expressions, no
shuffle and no Python. Each step keeps its result as a column so that long texts
are lowered, split and searched once.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from hearthbook import schema as S
from hearthbook.functions import coerce, fields as P, rules as R, scalars as X

# --------------------------------------------------------------------------
# Names, labels, keywords and patterns that decide the results.
# Lists are in order of precedence.
# --------------------------------------------------------------------------
KNOWN_PROVIDERS = (
    "British Gas",
    "EDF Energy",
    "E.ON Next",
    "E.ON",
    "Octopus Energy",
    "OVO Energy",
    "Scottish Power",
    "SSE",
    "Shell Energy",
    "Utilita",
    "Ecotricity",
    "Co-operative Energy",
    "Wessex Water",
    "Thames Water",
    "Yorkshire Water",
    "United Utilities",
    "Severn Trent",
    "Anglian Water",
    "Dŵr Cymru",
    "Welsh Water",
    "Northumbrian Water",
    "South West Water",
    "Scottish Water",
    "Bristol City Council",
    "Leeds City Council",
    "Cardiff Council",
    "Manchester City Council",
    "TV Licensing",
    "BT",
    "Virgin Media",
    "Sky",
    "TalkTalk",
    "Vodafone",
    "EE",
)
AMOUNT_LABELS = (
    "total amount due",
    "amount due",
    "total due",
    "balance due",
    "please pay",
    "new balance",
    "total charges",
    "amount payable",
    "total",
)
FREQUENCY_WORDS = {
    "monthly": ("per month", "monthly", "each month"),
    "quarterly": ("quarterly", "per quarter"),
    "annually": ("annually", "per year", "yearly"),
    "fortnightly": ("fortnightly",),
    "weekly": ("weekly",),
}
KIND_WORDS = {
    "councilTax": ("council tax",),
    "electricity": ("electricity", "mpan"),
    "gas": ("gas bill", "mprn"),
    "wastewater": ("wastewater", "sewerage"),
    "water": ("water",),
    "broadband": ("broadband", "fibre", "internet"),
    "tvLicence": ("tv licence", "tv license"),
    "homeInsurance": ("insurance",),
}
MONTHS = (
    "january",
    "february",
    "march",
    "april",
    "may",
    "june",
    "july",
    "august",
    "september",
    "october",
    "november",
    "december",
)
_WS = f"[{coerce.SPACE}]"
PROVIDER_LABEL = rf"Provider:{_WS}*(\w+)"
MONEY = rf"£{_WS}?([0-9][0-9,]*\.?[0-9]{{0,2}})"
_DIGIT_DATE = r"[0-9]{1,2}[/\-.][0-9]{1,2}[/\-.][0-9]{2,4}"
_NEAR_DUE = (
    r"(?:due date|due on|due by|payment due|please pay by|pay by|instalment due|next payment|due\b)"
    rf"{_WS}*[^0-9]{{0,24}}"
    rf"({_DIGIT_DATE}"
    r"|[0-9]{4}-[0-9]{2}-[0-9]{2}"
    rf"|[0-9]{{1,2}}(?:st|nd|rd|th)?{_WS}+(?:of{_WS}+)?[A-Za-z]{{3,9}}{_WS}+[0-9]{{2,4}}"
    rf"|[A-Za-z]{{3,9}}{_WS}+[0-9]{{1,2}}(?:st|nd|rd|th)?,?{_WS}+[0-9]{{2,4}})"
)
DUE_DATE = rf"(?i){_NEAR_DUE}"
LOOSE_DUE_DATE = rf"(?i)due[^0-9A-Za-z]{{0,8}}({_DIGIT_DATE})"
# The date shapes: ISO, day-month-year numbers, day and month name, month name and day.
DATE_SHAPES = (
    r"^(?:([0-9]{4})-([0-9]{2})-([0-9]{2})"
    r"|([0-9]{1,2})[/\-.]([0-9]{1,2})[/\-.]([0-9]{2,4})"
    rf"|([0-9]{{1,2}})(?:st|nd|rd|th)?{_WS}+(?:of{_WS}+)?([a-z]{{3,9}})\.?{_WS}+([0-9]{{2,4}})"
    rf"|([a-z]{{3,9}})\.?{_WS}+([0-9]{{1,2}})(?:st|nd|rd|th)?{_WS}+([0-9]{{2,4}}))$"
)


#: The note of a document that was read from a bill text, its fields settled by a person.
CAPTURED = "captured_from_bill_text"


# ---- dates ----------------------------------------------------------------


def date_parts(text: Column) -> Column:
    """[ISO year, printed year, month, day] of a printed date, null for other text.

    One pattern covers all shapes; only one alternative matches, so its groups can be
    picked by writing the groups of all alternatives next to each other. Text that
    does not match comes back unchanged.
    """
    value = F.replace(F.lower(coerce.trim(text)), F.lit(","), F.lit(""))
    picked = F.regexp_replace(value, DATE_SHAPES, r"$1|$6$9$12|$2$5$8$10|$3$4$7$11")
    return F.when((text != "") & (picked != value), F.split(picked, r"\|"))


def date_from_parts(parts: str, as_of: R.Day) -> Column:
    """The DATE of a ``date_parts`` column; days that do not exist give null.

    Two-digit years belong to the century of ``as_of``; in the all-number shape a
    year more than five back moves to the next century.
    """
    this_year = dt.date.fromisoformat(str(as_of)).year
    century = this_year - this_year % 100
    full = ", ".join(f"'{month}'" for month in MONTHS)
    short = ", ".join(f"'{month[:3]}'" for month in MONTHS)
    year = f"CAST({parts}[1] AS INT)"
    whole_year = (
        f"CASE WHEN {parts}[0] <> '' THEN CAST({parts}[0] AS INT) "
        f"WHEN {year} >= 100 THEN {year} "
        f"WHEN {parts}[2] RLIKE '[a-z]' OR {year} + {century} >= {this_year} - 5 THEN {year} + {century} "
        f"ELSE {year} + {century + 100} END"
    )
    month = (
        f"CASE WHEN {parts}[2] RLIKE '[a-z]' THEN CAST(nullif(greatest("
        f"array_position(array({full}), {parts}[2]), array_position(array({short}), {parts}[2]), "
        f"if({parts}[2] = 'sept', 9L, 0L)), 0L) AS STRING) ELSE {parts}[2] END"
    )
    return F.expr(
        f"try_cast(concat(lpad(CAST({whole_year} AS STRING), 4, '0'), '-', "
        f"lpad({month}, 2, '0'), '-', lpad({parts}[3], 2, '0')) AS DATE)"
    )


def with_date(rows: DataFrame, text: str, name: str, as_of: R.Day) -> DataFrame:
    """Add column ``name``: the printed date in column ``text``, day before month."""
    parts = f"_{name}_parts"
    split = rows.withColumn(parts, date_parts(F.col(text)))
    return split.withColumn(name, date_from_parts(parts, as_of)).drop(parts)


# ---- keyword rules --------------------------------------------------------


def _by_keyword(lowered: str, rules: dict[str, tuple[str, ...]]) -> Column:
    """First rule one of whose words occurs in the column of lowered text."""
    branches = [
        "WHEN " + " OR ".join(f"contains({lowered}, '{word}')" for word in words) + f" THEN '{result}'"
        for result, words in rules.items()
    ]
    return F.expr("CASE " + " ".join(branches) + " END")


def detect_frequency(lowered: str) -> Column:
    return _by_keyword(lowered, FREQUENCY_WORDS)


def detect_kind(lowered: str) -> Column:
    return _by_keyword(lowered, KIND_WORDS)


def detect_known_provider(text: str, lowered: str, word_boundary: bool = False) -> Column:
    """First listed name that occurs anywhere in the text, in any case.

    Matching is plain containment, so 'EE' is found inside 'fee'; with
    ``word_boundary`` a name must stand alone.
    """
    if not word_boundary:
        return _by_keyword(lowered, {name: (name.lower(),) for name in KNOWN_PROVIDERS})
    # A plain search first, in lower case with the letters that the pattern takes for i and s as well.
    folded = F.col(lowered)
    for other, letter in (("i\u0307", "i"), ("\u0131", "i"), ("\u017f", "s")):
        folded = F.replace(folded, F.lit(other), F.lit(letter))

    def first_alone(plain: Column) -> Column:
        chain = F
        for name in KNOWN_PROVIDERS:
            alone = F.col(text).rlike(rf"(?iu)(?<!\w)\Q{name}\E(?!\w)")
            chain = chain.when(F.contains(plain, F.lit(name.lower())) & alone, name)
        return chain.otherwise(F.lit(None).cast("string"))

    return F.get(F.transform(F.array(folded), first_alone), F.lit(0))


def label_priority(lowered_line: Column) -> Column:
    """Rank of the best amount label in a line, null without one."""
    chain = F
    for rank, label in enumerate(AMOUNT_LABELS):
        chain = chain.when(lowered_line.contains(label), rank)
    return chain.otherwise(F.lit(None).cast("int"))


# ---- lines and amounts ----------------------------------------------------


def bill_lines(text: Column) -> Column:
    """Trimmed, non-empty lines."""
    lines = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n")
    return F.filter(F.transform(lines, coerce.trim), lambda line: line != "")


def _pence(amount: Column) -> Column:
    """Pence of what the money pattern matched: digits, commas, at most one point."""
    pounds = F.replace(amount, F.lit(","), F.lit("")).try_cast("double")
    return F.round(pounds * 100, 0).try_cast("bigint")


def _money_lines(text: Column) -> Column:
    """Per line that names an amount: label rank, position, all its amounts in pence."""

    def read(line: Column, position: Column) -> Column:
        amounts = F.transform(F.regexp_extract_all(line, F.lit(MONEY), F.lit(1)), _pence)
        return F.struct(
            # Lowered once for all labels: bound to a name.
            F.get(F.transform(F.array(F.lower(line)), label_priority), F.lit(0)).alias("priority"),
            position.alias("position"),
            F.filter(amounts, lambda minor: minor.isNotNull()).alias("amounts"),
        )

    lines = F.filter(F.split(text, "\n"), lambda line: line.contains("£"))
    read_lines = F.filter(F.transform(lines, read), lambda line: F.size(line["amounts"]) > 0)
    # Most documents hold no amount at all: do not even split those.
    return F.when(text.contains("£"), read_lines)


def _labelled_amount(money_lines: Column) -> Column:
    """First amount of the first line with the best label."""
    labelled = F.filter(money_lines, lambda line: line["priority"].isNotNull())
    best = F.array_min(
        F.transform(
            labelled,
            lambda line: F.struct(
                line["priority"].alias("priority"),
                line["position"].alias("position"),
                F.get(line["amounts"], F.lit(0)).alias("minor"),
            ),
        )
    )
    return best["minor"]


# Every phrase of the pattern contains one of these words, at most so many characters after its start.
_SEEDS, _BEFORE = r"(?=due|pay by|next payment)", len("instalment ")
# A phrase, the gap and a date fit in such a window unless white space runs on and on.
_WINDOW, _LONG_GAP = 300, rf"{_WS}{{40}}"


def _due_text() -> Column:
    """The first date text near a due phrase, '' without one.

    The text is cut before each word that a phrase contains, by a plain search in lower case, and
    the pattern is anchored at these places one after another, until it matches: it is never tried anywhere
    else. The few texts whose places differ in lower case, or that hold a very long gap, are
    searched as a whole.
    """
    text, lower = F.col("_text"), F.col("_lower")
    anchored = rf"(?is)^.{{0,{_BEFORE}}}?{_NEAR_DUE}"

    def step(state: Column, part: Column) -> Column:
        start = F.greatest(state["place"] - _BEFORE, F.lit(0)) + 1
        found = F.when(state["found"] != "", state["found"]).otherwise(
            F.regexp_extract(F.substr(text, start, F.lit(_WINDOW)), anchored, 1)
        )
        return F.struct((state["place"] + F.length(part)).alias("place"), found.alias("found"))

    begin = F.struct(F.lit(0).alias("place"), F.lit("").alias("found"))
    seeded = F.aggregate(F.split(lower, _SEEDS), begin, step)["found"]
    near = F.expr("contains(_lower, 'due') OR contains(_lower, 'pay by') OR contains(_lower, 'next payment')")
    odd = (F.length(lower) != F.length(text)) | text.rlike(_LONG_GAP)
    return F.when(near & odd, F.regexp_extract(text, DUE_DATE, 1)).when(near, seeded).otherwise("")


# ---- the job --------------------------------------------------------------


def readable(documents: DataFrame, text: str = "text") -> DataFrame:
    """Documents long enough to read.

    As a filter this would move below the making of a derived text, which would then be made twice.
    """
    row = F.when(F.length(coerce.trim(F.col(text))) >= S.MIN_BILL_TEXT, F.struct(*documents.columns))
    return documents.select(F.inline(F.array_compact(F.array(row))))


def too_short(documents: DataFrame, text: str = "text") -> DataFrame:
    """The documents ``readable`` leaves out, for a person to look at."""
    size = F.coalesce(F.length(coerce.trim(F.col(text))), F.lit(0))
    return documents.where(size < S.MIN_BILL_TEXT)


def extract_bills(documents: DataFrame, as_of: R.Day, text: str = "text",
                  hint: str | None = None, word_boundary: bool = False, at: Column | None = None) -> DataFrame:
    """Read every document; the input columns stay, in front of the findings.

    Adds ``provider``, ``amount_minor`` and ``due_date`` (suggested or missing fields),
    ``detected_kind``, ``frequency`` and ``warnings`` (codes). ``hint`` names a column
    whose kind, where present, wins over the detected one. ``at`` is when the texts are read: what
    suggestions are recorded with. Too short texts are read as well: take them out with
    ``readable`` first.
    """
    source = F.lit("billExtraction")
    raw = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\r\n"), F.lit("\n"))
    searched = documents.withColumn("_text", raw).withColumn("_lower", F.lower("_text"))

    found = searched.withColumns(
        {
            "_known": detect_known_provider("_text", "_lower", word_boundary),
            "_money": _money_lines(F.col("_text")),
            "_due_text": _due_text(),
            "_kind": detect_kind("_lower"),
            "_frequency": detect_frequency("_lower"),
        }
    )
    label_word = F.when(F.col("_known").isNull(), F.regexp_extract("_text", PROVIDER_LABEL, 1))
    picked = found.withColumns(
        {
            "_word": F.nullif(label_word, F.lit("")),
            "_labelled": _labelled_amount(F.col("_money")),
            "_amounts": F.flatten(F.transform("_money", lambda line: line["amounts"])),
        }
    )
    strict = with_date(picked, "_due_text", "_due", as_of)
    # The looser pattern is only searched where the strict one gave no date.
    retried = strict.withColumn(
        "_loose_text",
        F.when(
            F.col("_due").isNull() & F.col("_lower").contains("due"),
            F.regexp_extract("_text", LOOSE_DUE_DATE, 1),
        ),
    )
    unlabelled = F.col("_labelled").isNull() & (F.size("_amounts") > 0)
    settled = with_date(retried, "_loose_text", "_loose", as_of).withColumns(
        {
            "_word": F.when(F.length("_word") >= 3, F.col("_word")),
            "_amount": F.coalesce("_labelled", F.array_max("_amounts")),
            "_date": F.coalesce("_due", "_loose"),
        }
    ).withColumn("_provider", F.coalesce("_known", "_word"))
    warnings = F.array_compact(
        F.array(
            F.when(F.col("_known").isNull() & F.col("_word").isNotNull(), "provider_from_label"),
            F.when(unlabelled & (F.size("_amounts") > 1), "several_amounts"),
            F.when(unlabelled & (F.size("_amounts") == 1), "single_unlabelled_amount"),
            F.when((F.col("_due_text") != "") & F.col("_due").isNull(), "unreadable_date"),
            F.when(F.col("_provider").isNull(), "missing_provider"),
            F.when(F.col("_amount").isNull(), "missing_amount"),
            F.when(F.col("_date").isNull(), "missing_date"),
        )
    )
    kind = F.coalesce(F.col(hint), F.col("_kind")) if hint else F.col("_kind")
    return settled.select(
        *[F.col(name) for name in documents.columns],
        P.suggested(
            F.col("_provider"),
            source,
            F.when(F.col("_known").isNotNull(), "name_list").otherwise("label"),
            at,
        ).alias("provider"),
        P.suggested(
            F.col("_amount"),
            source,
            F.when(F.col("_labelled").isNotNull(), "labelled").otherwise("largest"),
            at,
        ).alias("amount_minor"),
        P.suggested(
            F.col("_date"),
            source,
            F.when(F.col("_due").isNotNull(), "due_line").otherwise("loose"),
            at,
        ).alias("due_date"),
        kind.alias("detected_kind"),
        F.col("_frequency").alias("frequency"),
        warnings.alias("warnings"),
    )


def found_count() -> Column:
    """How many of the three fields an extracted row holds."""
    return sum(
        (P.has_value(F.col(name)).cast("int") for name in ("provider", "amount_minor", "due_date")),
        start=F.lit(0),
    )


def coverage(extracted: DataFrame, *keys: str) -> DataFrame:
    """How much was found over a corpus, per ``keys``."""
    counted = extracted.withColumn("_found", found_count())
    return counted.groupBy(*keys).agg(
        F.count("*").alias("document_count"),
        F.count_if(F.col("_found") > 0).alias("with_anything"),
        F.sum("_found").cast("bigint").alias("fields_found"),
    )


def accept_extracted(extracted: DataFrame, decisions: DataFrame) -> dict[str, DataFrame]:
    """Rows that follow from texts a person has accepted.

    ``extracted`` needs ``document_id``, ``household_id`` and ``text``; ``decisions`` has
    ``document_id`` plus what the person settled on: ``kind, provider, amount_text,
    due_date, frequency`` and ``decided_at``. Without a readable amount and a date
    nothing is saved; those come back as ``incomplete``. A null in a decision keeps
    what was read. Of several decisions on one text the last by ``decided_at`` counts; one without it has not
    been made. Returns ``documents``, ``bills`` and ``incomplete``; for the services
    of the same kind pass the bills on to ``commands.sync_slots``.
    """
    choices = ["decided_at", "kind", "provider", "amount_text", "due_date", "frequency"]
    last = decisions.where("decided_at IS NOT NULL").groupBy("document_id").agg(F.max(F.struct(*choices)).alias("_last"))
    settled = last.select("document_id", "_last.*").select(
        "document_id",
        F.col("kind").alias("_kind"),
        coerce.non_blank(F.col("provider")).alias("_provider"),
        X.parse_money(F.col("amount_text")).alias("_amount"),
        F.col("amount_text").alias("_amount_text"),
        F.col("due_date").alias("_due"),
        F.col("frequency").alias("_frequency"),
        "decided_at",
    )
    typed = F.when(
        F.col("_amount_text").isNull(), F.col("amount_minor")["value"]
    ).otherwise(F.col("_amount"))
    joined = extracted.join(settled, "document_id").select(
        "document_id",
        S.KEY,
        F.concat(F.lit("bill-"), F.col("document_id")).alias("bill_id"),
        F.coalesce("_kind", "detected_kind", F.lit("other")).alias("kind"),
        F.coalesce("_provider", F.col("provider")["value"]).alias("provider_name"),
        typed.alias("amount"),
        F.coalesce("_due", F.col("due_date")["value"]).alias("due"),
        F.coalesce("_frequency", "frequency", F.lit("monthly")).alias("frequency"),
        coerce.trim(F.col("text")).alias("extracted_text"),
        "decided_at",
    )
    complete = F.col("amount").isNotNull() & F.col("due").isNotNull()
    saved = joined.where(complete)
    documents = saved.select(
        "document_id",
        S.KEY,
        F.lit("bill").alias("kind"),
        F.concat(X.kind_label(F.col("kind")), F.lit(" bill")).alias("title"),
        "provider_name",
        "extracted_text",
        F.lit(CAPTURED).alias("notes"),
        F.col("decided_at").alias("created_at"),
    )
    bills = saved.select(
        "bill_id",
        S.KEY,
        "kind",
        P.confirmed(F.col("provider_name"), recorded_at=F.col("decided_at")).alias("provider"),
        P.confirmed(F.col("amount"), "userEntered", recorded_at=F.col("decided_at")).alias(
            "amount_minor"
        ),
        P.confirmed(F.col("due"), recorded_at=F.col("decided_at")).alias("due_date"),
        "frequency",
        F.lit("unknown").alias("payment_status"),
        "document_id",
        F.col("decided_at").alias("created_at"),
        F.col("decided_at").alias("updated_at"),
    )
    return {
        "documents": documents,
        "bills": bills,
        "incomplete": joined.where(~complete).select("document_id", S.KEY),
    }
