"""Secret scans with an incremental blob ledger, in SQL expressions only.

A blob is the SHA-256 of a text: every version of every document is content-addressed, and equal
contents are one blob however many paths hold them. A ledger (a parquet folder that only grows) records
which rule versions a blob has been scanned with and what they found. A scan reads the documents, keeps
the (blob, rule version) pairs that the ledger lacks, evaluates only those, appends the outcome, and
joins all findings of the wanted rule versions back to the documents. A rule's new version is a new
pair; old findings stay in the ledger and are no longer asked for.

Duplicates collapse before the shuffle (one row per blob and task), and the join back carries ids only;
a blob that very many documents share is a skewed join key, which AQE splits.

Defined results: a null text is the empty blob, which has no findings; repeated rows each get the
findings of their blob; an empty table gives an empty result; `redacted` keeps the input's columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tocsin.llm.shared import id_and_text, new_folder


@dataclass(frozen=True)
class Rule:
    """A kind of secret; without a pattern, private keys. `needs`: a text without this string has no match; `group`, `least`: what must be that long."""

    kind: str
    version: int
    pattern: str
    needs: str = ""
    group: int = 0
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# fixed values: the three base kinds
_KEYWORD = (
    "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"
    "|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
)
BASE = (
    Rule("assign", 1, _KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=8),
    Rule("access", 1, "AKIA[A-Z0-9]{12,}", needs="AKIA"),
    Rule("hex", 1, "[0-9a-f]{32,}"),
)
# A key runs from BEGIN to its END line, if that comes before the next BEGIN, or else over the base64 behind BEGIN
# (and over named values, up to the blank line that ends them). The patterns hold no repeated groups: Java takes
# stack for each round of these, but none for a repeated class, so a key may be of any length.
BEGIN = "-----BEGIN "
_LABEL = "[A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
_BASE64, _BETWEEN = "A-Za-z0-9+/=", r"""[ \t\r\n\\"'>#*]+"""
KEY_LABEL = "^" + _LABEL
KEY_WHOLE = f"^{_LABEL}(?s:.*?)-----END {_LABEL}"
KEY_NAMED = r"^[ \t\r\n>]*[A-Za-z][A-Za-z-]*: (?s:.*?)\n[ \t\r>]*\n"
KEY_STOP = rf"{_BETWEEN}[{_BASE64}]{{0,15}}(?:[^{_BASE64}]|\z)"  # the first string that is too short for a line
KEY_LAST = rf"^\r?\n[{_BASE64}]+(?:\r?\n|\z)"
# further kinds that public services document
MORE = (
    Rule("private_key", 3, "", needs=BEGIN),
    Rule("github", 1, "gh[pousr]_[A-Za-z0-9]{36,}", needs="gh"),
    Rule("slack", 1, "xox[abprs]-[A-Za-z0-9-]{10,}", needs="xox"),
    Rule("google", 1, "AIza[A-Za-z0-9_-]{35}", needs="AIza"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", needs="eyJ"),
)
RULES = BASE + MORE

SPAN = "struct<kind:string,start:long,end:long>"
LEDGER = f"blob binary, rules array<string>, findings array<struct<rule:string,spans:array<{SPAN}>>>"


def once(value: Column, use) -> Column:
    """`use(value)` with `value` worked out once, however often `use` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def key_length(part: Column) -> Column:
    """How much of what follows a BEGIN belongs to a private key; 0 if it isn't one."""
    found = lambda value, pattern: F.regexp_extract(value, pattern, 0)
    after = lambda value, length: F.substring(value, length + 1, F.length(value))

    def body(rest: Column) -> Column:
        lines = F.length(F.get(F.split(rest, KEY_STOP, 2), F.lit(0)))
        last = lambda n: F.when(n > 0, n + F.length(found(after(rest, n), KEY_LAST))).otherwise(0)
        return once(lines, last)

    def open_key(rest: Column) -> Column:
        named = F.length(found(rest, KEY_NAMED))
        with_named = lambda n: once(body(after(rest, n)), lambda m: F.when((n > 0) & (m > 0), n + m).otherwise(body(rest)))
        return once(named, with_named)

    def length(label: Column) -> Column:
        whole = F.length(found(part, KEY_WHOLE))
        return F.when(label == 0, 0).otherwise(
            once(whole, lambda n: F.when(n > 0, n).otherwise(label + open_key(after(part, label))))
        )

    return once(F.length(found(part, KEY_LABEL)), length)


def key_spans(text: Column, kind: str) -> Column:
    """Places of private keys: a text is cut at each BEGIN, and each part behind one is measured."""
    none = F.array().cast(f"array<{SPAN}>")

    def step(done: Column, part: Column) -> Column:
        def place(n: Column) -> Column:
            end = done["at"] + len(BEGIN) + n
            return F.struct(F.lit(kind).alias("kind"), done["at"].alias("start"), end.cast("long").alias("end"))

        add = lambda n: F.when(n > 0, F.array_append(done["found"], place(n))).otherwise(done["found"])
        more = once(key_length(part), add)
        return F.struct((done["at"] + len(BEGIN) + F.length(part)).cast("long").alias("at"), more.cast(f"array<{SPAN}>").alias("found"))

    def over(parts: Column) -> Column:
        start = F.struct(F.length(F.get(parts, F.lit(0))).cast("long").alias("at"), none.alias("found"))
        return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), start, step, lambda done: done["found"])

    return F.when(F.contains(text, F.lit(BEGIN)), once(F.split(text, BEGIN, -1), over)).otherwise(none)


def spans_of(text: Column, rule: Rule) -> Column:
    """Places (code points, end exclusive) of the rule's leftmost, non-overlapping matches.

    The text between matches and the matches take turns, so lengths add up to places.
    """
    none = F.array().cast(f"array<{SPAN}>")
    if not rule.pattern:
        return key_spans(text, rule.kind)

    def places(matches: Column, gaps: Column) -> Column:
        pairs = F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
        start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("found"))

        def step(done: Column, pair: Column) -> Column:
            begin = done["at"] + F.length(pair["g"])
            end = begin + F.length(pair["m"])
            span = F.struct(F.lit(rule.kind).alias("kind"), begin.alias("start"), end.alias("end"))
            long_enough = F.lit(True)
            if rule.least:
                long_enough = F.length(F.regexp_extract(pair["m"], rule.pattern, rule.group)) >= rule.least
            found = F.when(long_enough, F.array_append(done["found"], span)).otherwise(done["found"])
            return F.struct(end.alias("at"), found.cast(f"array<{SPAN}>").alias("found"))

        return F.aggregate(pairs, start, step, lambda done: done["found"])

    def all_of(matches: Column) -> Column:
        gaps = F.split(text, rule.pattern, -1)
        return F.when(F.size(matches) == 0, none).otherwise(once(gaps, lambda g: places(matches, g)))

    found = once(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), all_of)
    return F.when(F.contains(text, F.lit(rule.needs)), found).otherwise(none) if rule.needs else found


def read_ledger(spark, folder: str) -> DataFrame | None:
    """The ledger's rows; None before the first scan."""
    try:
        return spark.read.schema(LEDGER).parquet(folder)
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def append_unseen(docs: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scan the (blob, rule version) pairs that the ledger in `folder` lacks and append the outcome."""
    wanted = F.array(*[F.lit(r.key) for r in rules])
    blobs = id_and_text(docs).select(blob_of(F.col("text")).alias("blob"), "text").dropDuplicates(["blob"])
    ledger = read_ledger(docs.sparkSession, folder)
    if ledger is None:
        pending = blobs.withColumn("rules", wanted)
    else:
        seen = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob")
        seen = seen.agg(F.collect_set("rule").alias("seen"))  # as many as there are rule versions
        pending = blobs.join(seen, "blob", "left").withColumn(
            "rules", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
        )
    findings = F.array(
        *[
            F.struct(
                F.lit(r.key).alias("rule"),
                F.when(F.array_contains("rules", r.key), spans_of(F.col("text"), r)).alias("spans"),
            )
            for r in rules
        ]
    )
    scanned = pending.where(F.size("rules") > 0).select(
        "blob", "rules", F.filter(findings, lambda f: F.size(F.coalesce(f["spans"], F.array())) > 0).alias("findings")
    )
    scanned.write.mode("append").parquet(folder)


def findings_of(spark, folder: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob and spans, for every blob of the ledger in which one of these rule versions found something."""
    wanted = [r.key for r in rules]
    found = read_ledger(spark, folder).where(F.size("findings") > 0)
    found = found.select("blob", F.explode("findings").alias("f")).where(F.col("f.rule").isin(wanted))
    # a blob may be in the ledger twice, when two scans ran at once or one was repeated
    return found.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("f.spans"))).alias("spans"))


def in_order(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans by start, then kind as listed, then end."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    keyed = F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("k"), s.alias("s"))
    )
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def scan(docs: DataFrame, folder: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans (kind, start, end; in order) of every document, by way of the ledger in `folder`."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "ledger")
    append_unseen(docs, folder, rules)
    paths = id_and_text(docs).select("doc_id", blob_of(F.col("text")).alias("blob"))
    found = paths.join(findings_of(spark, folder, rules), "blob", "left")
    none = F.array().cast(f"array<{SPAN}>")
    return found.select("doc_id", in_order(F.coalesce("spans", none), rules).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, base digest and the spans as text."""
    base = [r.kind for r in BASE]
    said = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, said), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def redacted(docs: DataFrame, folder: str | None = None, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]"):
    """The documents with every found span replaced by `mask`; a column n_chars follows the new text."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "ledger")
    append_unseen(docs, folder, rules)
    # the row travels as one struct, so that its columns' names can't clash with these
    row, text = F.col("row"), F.col("row.text")

    def step(done: Column, s: Column) -> Column:
        before = F.when(s["start"] >= done["at"], F.concat(text.substr((done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int")), F.lit(mask)))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.concat(done["out"], F.coalesce(before, F.lit(""))).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    rest = lambda done: F.concat(done["out"], text.substr((done["at"] + 1).cast("int"), F.length(text)))
    clean = F.aggregate(in_order(F.col("spans"), rules), start, step, rest)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), blob_of(F.coalesce(docs["text"], F.lit(""))).alias("blob"))
    found = keyed.join(findings_of(spark, folder, rules), "blob", "left")
    found = found.select("row", F.when(F.col("spans").isNull(), text).otherwise(clean).alias("clean"), F.col("spans").isNotNull().alias("changed"))
    out = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out["n_chars"] = F.when(F.col("changed"), F.length("clean").cast(kind)).otherwise(row["n_chars"])
    return found.select(*[out.get(c, row.getField(c)).alias(c) for c in docs.columns])
