"""Secret scans with corpus-wide ownership frequency.

Candidates are found in whole texts by patterns, JVM-side: a text is split at the matches, and running sums
of the pieces' lengths give the spans in code points. The candidates' hashes are then counted over the whole
corpus by the documents (repositories) and sources (owners) that hold them. A value that many owners, or many
documents of several owners, hold is a copied example; one that a single owner holds is live-looking, in however
many documents. Spans of the base kinds always stay; the wider kinds (below) count as secrets only where their
value is live-looking.

Edge cases: a null or empty text has no spans; empty strings are hashed for it. Equal values in repeated rows
count once per document. Null ids and null sources count as one document and one owner of their own. Very
long texts are scanned whole, and very many matches of a text in time that grows with their number. An empty table gives an empty result. No other columns are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanloom.llm.common import cut, text_or_empty, written

#: Fixed values of the query's contract: the base kinds, in the order in which ties are listed.
ASSIGN = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: Wider kinds of the method: other well-known shapes of keys, and private key blocks.
BEARER = "[Bb][Ee][Aa][Rr][Ee][Rr]\\x20+[A-Za-z0-9+/_.=-]{16,}"
ISSUED = "\\b(?:ghp_|gho_|ghs_|github_pat_|glpat-|sk_live_|rk_live_|sk-|xox[abprs]-)[A-Za-z0-9_-]{16,}"
SIGNED = "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"
PRIVATE = "-----BEGIN[A-Z\\x20]*PRIVATE\\x20KEY-----"
KINDS = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("bearer", BEARER), ("issued", ISSUED), ("signed", SIGNED), ("private", PRIVATE))
BASE_KINDS = ("assign", "access", "hex")
#: A cheap test that no text with a match of that kind fails.
HINTS = {
    "assign": "[:=]",
    "access": "AKIA",
    "hex": "[0-9a-f]{24}",
    "bearer": "[Bb][Ee][Aa][Rr][Ee][Rr]\\x20",
    "issued": "ghp_|gho_|ghs_|github_pat_|glpat-|sk_live_|rk_live_|sk-|xox",
    "signed": "eyJ",
    "private": "-----BEGIN",
}
SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string>>"
#: Entries of an array that are added up one after the other, and code points of a piece of a text that is cut.
STEP, PIECE = 256, 4096


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, combine, empty: int) -> Column:
    """For each entry of an array of bigint, the entries before it combined; time grows with the array's length.

    An array that grows by an entry a step is copied each time, so steps are taken in parts of STEP entries.
    """
    nothing = F.array().cast("array<bigint>")
    begin = F.struct(F.lit(empty).cast("bigint").alias("at"), nothing.alias("out"))

    def scanned(entries: Column, entry) -> Column:
        step = lambda state, x: F.struct(combine(state["at"], entry(x)).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))
        return F.aggregate(entries, begin, step)

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / STEP).cast("int")), lambda k: scanned(F.slice(values, k * STEP + 1, F.lit(STEP)), lambda x: x))
    joined = let(parts, lambda p: F.flatten(F.zip_with(p, scanned(p, lambda part: part["at"])["out"], lambda part, before: F.transform(part["out"], lambda x: combine(before, x)))))
    return F.when(F.size(values) > 0, joined).otherwise(nothing)


def spans_of(text: Column, kind: str, rank: int, pattern: str) -> Column:
    """The matches of one kind as an array of SPAN's structs, leftmost and non-overlapping, in order."""
    def placed(pair: Column) -> Column:
        lengths = F.zip_with(F.slice(pair["pieces"], 1, F.size(pair["found"])), pair["found"], lambda piece, value: (F.length(piece) + F.length(value)).cast("bigint"))

        def spans(before: Column) -> Column:
            def span(value: Column, i: Column) -> Column:
                start = F.get(before, i) + F.length(F.get(pair["pieces"], i))
                return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(value)).alias("end"), F.lit(kind).alias("kind"), value.alias("value"))

            return F.transform(pair["found"], span).cast(SPAN)

        return let(running(lengths, lambda a, b: a + b, 0), spans)

    pair = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return F.when(text.rlike(HINTS[kind]) & text.rlike(pattern), let(pair, placed)).otherwise(F.array().cast(SPAN))


def secret_value(kind: Column, value: Column) -> Column:
    """What ownership is counted of: the value that is assigned, or the whole match."""
    return F.when(kind == "assign", F.regexp_extract(value, ASSIGN, 2)).otherwise(value)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, owner, spans: every candidate of a row, with failing ones dropped. A row for each row."""
    owner = F.col(owner_col).cast("string") if owner_col else F.lit(None).cast("string")
    base = docs.select(F.col(id_col).alias("doc_id"), owner.alias("owner"), text_or_empty(text_col).alias("__text"), *carry)
    text = F.col("__text")
    found = F.concat(*[spans_of(text, kind, rank, pattern) for rank, (kind, pattern) in enumerate(KINDS)])
    passing = F.filter(found, lambda s: (s["kind"] != "assign") | (F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 6))
    return base.select("doc_id", "owner", F.array_sort(passing).alias("spans"), *carry)


def ownership(scanned: DataFrame) -> DataFrame:
    """Per candidate hash over the whole corpus: distinct documents and owners. Partial sums come before any shuffle."""
    each = scanned.where(F.size("spans") > 0).select("doc_id", "owner", F.explode("spans").alias("span"))
    hashed = each.select(F.sha2(secret_value(F.col("span.kind"), F.col("span.value")), 256).alias("hash"), "doc_id", "owner")
    # Equal (hash, owner, document) meet first, so that a value in a third of all rows is small by then. Structs count nulls.
    by_doc = hashed.groupBy("hash", "owner", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return by_doc.groupBy("hash").agg(F.count_distinct(F.struct("doc_id")).alias("n_docs"), F.count_distinct(F.struct("owner")).alias("n_owners"), F.sum("n").alias("n_found"))


def find_secrets(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str | None = "source",
    max_live_owners: int = 2,
    max_live_docs: int = 8,
) -> DataFrame:
    """doc_id, spans (base ones, and live ones of the wider kinds), n_live, n_copied. A row for each row.

    A value is live-looking if a single owner holds it, or at most ``max_live_owners`` owners and ``max_live_docs`` documents.
    Without owners all rows are one owner's, so that no value counts as copied.
    """
    scanned = scan(docs, id_col=id_col, text_col=text_col, owner_col=owner_col).withColumn("__row", F.monotonically_increasing_id())
    # Spans are a small part of the texts, which are read and matched once.
    return judge(cut(scanned), max_live_owners, max_live_docs).select("doc_id", "spans", "n_live", "n_copied")


def decide(scanned: DataFrame, max_live_owners: int = 2, max_live_docs: int = 8) -> DataFrame:
    """__row, stay (the spans that stay), n_live, n_copied of scan()'s rows, stored, that have candidates; the others have nothing to decide."""
    shared = F.col("n_owners") > 1  # an owner may copy a credential of its own as often as it likes
    owned = ownership(scanned).where(shared & ((F.col("n_owners") > max_live_owners) | (F.col("n_docs") > max_live_docs))).select("hash", F.lit(True).alias("copied"))
    each = scanned.where(F.size("spans") > 0).select("__row", F.explode("spans").alias("span"))
    each = each.withColumn("hash", F.sha2(secret_value(F.col("span.kind"), F.col("span.value")), 256))
    # A copied value may be in a third of all rows: its few hashes are spread over salts.
    salts = 16
    salted = owned.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    marked = each.withColumn("salt", F.pmod(F.col("__row"), F.lit(salts)).cast("int")).join(salted, ["hash", "salt"], "left")
    live = F.col("copied").isNull()
    stays = F.col("span.kind").isin(*BASE_KINDS) | live
    return marked.groupBy("__row").agg(
        F.array_sort(F.collect_list(F.when(stays, F.col("span")))).alias("stay"),
        F.count(F.when(stays & live, 1)).alias("n_live"),
        F.count(F.when(~live, 1)).alias("n_copied"),
    )


def judge(scanned: DataFrame, max_live_owners: int = 2, max_live_docs: int = 8, carry: tuple[str, ...] = ()) -> DataFrame:
    """Decide on the candidates of scan()'s rows, stored, by ownership; only rows with candidates are shuffled."""
    by_row = decide(scanned, max_live_owners, max_live_docs)
    without = scanned.where(F.size("spans") == 0).select("doc_id", "spans", F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_copied"), "__row", *carry)
    with_spans = scanned.where(F.size("spans") > 0).select("doc_id", "__row", *carry).join(by_row, "__row")
    return without.unionByName(with_spans.select("doc_id", F.col("stay").alias("spans"), "n_live", "n_copied", "__row", *carry))


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source") -> DataFrame:
    """The input rows with the spans of find_secrets() replaced in their texts; all columns stay.

    Texts are matched once: rows and spans are stored, and only rows with spans are shuffled. Input columns may be called
    like any of this module's own.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    owner = F.col(owner_col).cast("string") if owner_col else F.lit(None).cast("string")
    narrow = docs.select(F.col(id_col).alias("doc_id"), owner.alias("owner"), F.col(text_col).alias("text"), row)
    scanned = written(lambda: scan(narrow, owner_col="owner", carry=("row",)).withColumn("__row", F.monotonically_increasing_id()), docs.sparkSession)
    decided = decide(scanned.select("doc_id", "owner", "spans", "__row")).where(F.size("stay") > 0).select("__row", "stay")
    some = scanned.where(F.size("spans") > 0).select("row", "__row").join(cut(decided), "__row", "left")
    text = F.col(f"row.`{text_col}`")
    clean = F.when(F.col("stay").isNull(), text).otherwise(redact(text, F.col("stay")))
    cleaned = some.select(*[(clean if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
    return scanned.where(F.size("spans") == 0).select("row.*").unionByName(cleaned)


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with its spans replaced; overlapping spans become one mark. Spans come by start.

    A place in a string is found by counting from its beginning, so the text is cut into pieces first, and what stays
    between two spans is taken from the pieces that hold it.
    """

    def cleaned(pieces: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            first, last = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
            head = F.substr(F.get(pieces, first), (a % PIECE + 1).cast("int"), F.when(first == last, b - a).otherwise(F.lit(PIECE)).cast("int"))
            middle = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
            tail = F.coalesce(F.substr(F.get(pieces, last), F.lit(1), (b % PIECE).cast("int")), F.lit(""))
            return F.when(b > a, F.concat(head, F.when(last > first, F.concat(middle, tail)).otherwise(F.lit("")))).otherwise(F.lit(""))

        def parts(ends: Column) -> Column:
            """``ends``: for each span, how far those before it reach."""
            kept = F.transform(spans, lambda s, i: F.when(s["start"] >= F.get(ends, i), F.concat(between(F.get(ends, i), s["start"]), F.lit(mark))).otherwise(F.lit("")))
            reach = F.greatest(F.element_at(ends, -1), F.element_at(spans, -1)["end"])
            return F.concat(F.array_join(kept, ""), between(reach, F.length(text).cast("bigint")))

        return let(running(F.transform(spans, lambda s: s["end"]), F.greatest, 0), parts)

    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / PIECE).cast("int")), lambda k: F.substr(text, k * PIECE + 1, F.lit(PIECE)))
    return F.when(F.size(spans) > 0, let(pieces, cleaned)).otherwise(text)
