"""Personal data: patterns, and terms that give them away.

Base kinds are found by pattern. Then the corpus tells how much a term reveals of a value that it shares texts with: with
counts of whole documents, ``log2 p(value, term) / (p(value) p(term))`` over ``-log2 p(value)`` is the share of the value's
information that the term carries. A term above ``DISCLOSURE`` that meets a value more often than ``CHANCE`` allows over all
pairs is a span of kind ``term`` wherever it stands, to be generalised like the values themselves. DataFrame and SQL functions only.

The patterns are written so that the engine neither recurses nor backs up: possessive repeats where what follows
cannot start inside, and a start only where a run starts or the last match ended. Their matches are the plain ones'. Work is
linear in a text's length and its matches: places are running sums over what ``split`` leaves between matches, made in chunks
because an array can only grow by being copied.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from creditloom.llm.base import ready
from creditloom.session import cut_lineage

KINDS = ("email", "ip", "card", "phone", "term")
# A card is written with the fewest digits that count, as shorter runs of digits fail anyway.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
GENERAL = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}
WORD = r"\\p{L}{3,}"
# Characters between a value and the matches beside it that tell its contexts apart, so that copies and near copies count as one.
CONTEXT = 80
# Pairs of a value and a term are believed if fewer than this many of all pairs are expected to meet as often by chance.
CHANCE = 0.05
# Different contexts a (value, term) pair is seen in at the least, however unlikely it is.
MIN_CONTEXTS = 1
DISCLOSURE = 0.8
# Items of a chunk when sums run over an array, and characters of a text's block when parts are taken from it.
CHUNK = 512
BLOCK = 4096
_SPAN = "struct<start: int, kind: int, end: int, value: string>"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``value``, worked out once, under a name."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _before(items: str, own: str, join: str) -> str:
    """SQL: for each item x of an array, what ``join`` (of a and b) makes of ``own`` over the items before it."""

    def grown(at: str) -> str:
        return join.format(a=at, b=own)

    def listed(of: str, start: str, step: str, x: str) -> str:
        return f"""aggregate({of}, named_struct('at', {start}, 'all', cast(array() as array<int>)),
            (acc, {x}) -> named_struct('at', {step}, 'all', concat(acc.all, array(acc.at))), acc -> acc.all)"""

    total = f"aggregate(c, 0, (t, x) -> {grown('t')})"
    starts = listed("chunks", "0", join.format(a="acc.at", b=total), "c")
    inside = listed("c", "o", grown("acc.at"), "x")
    chunks = f"transform(sequence(0, cast((size({items}) - 1) / {CHUNK} as int)), i -> slice({items}, i * {CHUNK} + 1, {CHUNK}))"
    found = _let("chunks", chunks, f"flatten(zip_with(chunks, {starts}, (c, o) -> {inside}))")
    return f"if(size({items}) = 0, cast(array() as array<int>), {found})"


def _located(text: str, pattern: str, number: int, holds: str, start: str = "0") -> str:
    """SQL: the matches of a pattern (SQL) in a text that hold, as spans with the text before and behind them."""
    matched = f"zip_with(regexp_extract_all({text}, {pattern}, 0), gaps, (m, g) -> struct(m, g))"
    at = _before("found", "length(x.g) + coalesce(length(x.m), 0)", "{a} + {b}")
    spans = f"""filter(zip_with(zip_with(found, {at}, (x, at) -> struct(x.m as value, x.g as g, at + {start} + length(x.g) as start)),
        slice(gaps, 2, size(gaps)), (x, behind) -> struct(x.start, {number} as kind, x.start + length(x.value) as end, x.value,
            xxhash64(right(x.g, {CONTEXT}), left(behind, {CONTEXT})) as context)), s -> s.value is not null and {holds})"""
    return _let("gaps", f"split({text}, {pattern}, -1)", _let("found", matched, spans))


_NEAR = "array<struct<start: int, kind: int, end: int, value: string, context: bigint>>"


def _spans(kind: str) -> str:
    """SQL: the valid matches of a base kind in ``__text``."""
    digits = "regexp_replace(s.value, '[^0-9]', '')"
    holds = {
        "email": "true",
        "ip": "forall(split(s.value, '[.]'), p -> cast(p as double) <= 255)",
        "card": f"length({digits}) between 14 and 19 and luhn_check({digits})",
        "phone": f"length({digits}) between 10 and 15",
    }[kind]
    needs = {"email": "contains(__text, '@')", "ip": "__digit and contains(__text, '.')", "card": "__digit", "phone": "__digit and contains(__text, '+')"}[kind]
    return f"if({needs}, {_located('__text', _sql(PATTERNS[kind]), KINDS.index(kind), holds)}, cast(array() as {_NEAR}))"


def base_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, __null, __doc, __text, spans) of every row: base spans by start, then kind, with a hash of their surroundings.

    ``__doc`` holds the columns to keep.
    """
    ready(docs.sparkSession)
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in keep]).alias("__doc"),
        F.col(text).isNull().alias("__null"),
        F.coalesce(F.col(text), F.lit("")).alias("__text"),
    )
    rows = rows.withColumn("__digit", F.col("__text").rlike("[0-9]"))
    spans = F.expr("array_sort(concat(" + ", ".join(_spans(k) for k in KINDS[:4]) + "))")
    return rows.withColumn("spans", spans).drop("__digit")


def _analysed(docs: DataFrame) -> DataFrame:
    """(__row, digest, near, words) of the result of base_spans, without texts; to be written before its use.

    ``__row`` tells rows apart, ``near`` are the values in lower case with their contexts, ``words`` the different words outside of emails, in their
    case (the other kinds hold no letters).
    """
    outside = f"if(contains(__text, '@'), regexp_replace(__text, {_sql(PATTERNS['email'])}, ' '), __text)"
    return docs.select(
        F.monotonically_increasing_id().alias("__row"),
        F.md5(F.col("__text").cast("binary")).alias("digest"),
        F.expr("transform(spans, s -> struct(lower(s.value) as value, s.context))").alias("near"),
        F.expr(f"array_distinct(regexp_extract_all({outside}, '{WORD}', 0))").alias("words"),
    )


def _log_chance(k: Column, n: Column, q: Column) -> Column:
    """Logarithm of a bound (Chernoff) on the chance that k or more of n texts hold a word that a share q of all texts holds."""
    a = k / n
    rest = F.when(k < n, (1 - a) * F.log((1 - a) / (1 - q))).otherwise(0.0)
    return F.when(a > q, -n * (a * F.log(a / q) + rest)).otherwise(0.0)


def revealing(found: DataFrame) -> DataFrame:
    """(value, term, disclosure) of the pairs beyond both thresholds; ``found`` is the written result of _analysed.

    A pair's rows are those that hold both anywhere. Chance is judged on different contexts only, so copies are no evidence.
    """
    total = float(found.count())
    # One row per term and document; the partial count before the shuffle leaves one row per term and task.
    held = found.select(F.explode(F.array_distinct(F.transform("words", F.lower))).alias("term"))
    counts = cut_lineage(held.groupBy("term").agg(F.count("*").alias("n_term")))
    # A value's context in a text is that of its first place.
    holds = found.filter("size(near) > 0").select("__row", F.posexplode("near").alias("pos", "n")).groupBy("__row", "n.value").agg(
        F.min(F.struct("pos", "n.context"))["context"].alias("context")
    )
    holds = cut_lineage(holds)
    contexts = holds.groupBy("value", "context").agg(F.count("*").alias("rows"))
    values = cut_lineage(contexts.groupBy("value").agg(F.sum("rows").alias("n_value"), F.count("*").alias("n_context")))
    # Every value is tried with every term.
    tried = F.lit(math.log(max(counts.count(), 1)) + math.log(max(values.count(), 1)))

    def share(n_pair: Column) -> Column:
        return F.log2(F.lit(total) * n_pair / (F.col("n_value") * F.col("n_term"))) / F.log2(F.lit(total) / F.col("n_value"))

    def certain(k: Column) -> Column:
        return (k >= MIN_CONTEXTS) & (tried + _log_chance(k, F.col("n_context"), F.col("n_term") / total) <= F.log(F.lit(CHANCE)))

    # What the counts of value and term allow at most rules out common words, and values seen too seldom, before any pair is made.
    values = cut_lineage(
        values.filter(F.col("n_value") < total).withColumn("n_term", F.lit(1)).filter(certain(F.col("n_context"))).drop("n_term")
    )
    most = values.agg(F.max("n_value")).first()[0]
    if most is None:
        return found.sparkSession.createDataFrame([], "value string, term string, disclosure double")
    rare = counts.filter(F.col("n_term") <= math.ceil(total * (most / total) ** DISCLOSURE) + 1)
    valued = holds.join(values, "value")
    words = found.filter("size(near) > 0").select("__row", F.explode(F.array_distinct(F.transform("words", F.lower))).alias("term"))
    possible = (share(F.least("n_value", "n_term")) >= DISCLOSURE) & certain(F.col("n_context"))
    pairs = words.join(rare, "term").join(valued, "__row").filter(possible)
    sums = pairs.groupBy("value", "term", "context", "n_value", "n_context", "n_term").agg(F.count("*").alias("rows"))
    sums = sums.groupBy("value", "term", "n_value", "n_context", "n_term").agg(F.sum("rows").alias("n_pair"), F.count("*").alias("k"))
    return (
        sums.filter(certain(F.col("k"))).select("value", "term", share(F.col("n_pair")).alias("disclosure")).filter(F.col("disclosure") >= DISCLOSURE)
    )


def all_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, __null, __doc, __text, spans): base spans and terms of every row, by start, then kind.

    Null and empty texts have no spans; repeated rows stay repeated, a null id is kept, an empty table gives no rows, other columns may have
    any name. A revealing term is a span wherever it stands outside of emails, in texts without the value too. Texts are read twice and not written: what
    is written of a text are its words and values, and which texts hold a term is told by their digests.
    """
    rows = base_spans(docs, key, text, keep)
    found = cut_lineage(_analysed(rows))
    terms = cut_lineage(revealing(found).select("term").distinct())
    words = found.select("digest", F.explode("words").alias("word")).withColumn("term", F.lower("word"))
    hits = words.join(terms, "term").groupBy("digest").agg(F.array_sort(F.collect_set("word")).alias("__words"))
    hits = cut_lineage(hits)
    joined = rows.withColumn("digest", F.md5(F.col("__text").cast("binary"))).join(hits.hint("merge"), "digest", "left")
    # The words of a row that are terms, in their case, as a pattern of whole words.
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join("__words", "|"), F.lit(r")(?!\p{L})"))
    joined = joined.withColumn("__hits", F.when(F.size("__words") > 0, pattern))
    email = _sql(PATTERNS["email"])
    starts = _before("parts", "length(x.p) + coalesce(length(x.m), 0)", "{a} + {b}")
    inside = _located("q.p", "__hits", KINDS.index("term"), "true", "base")
    parts = f"""if(contains(__text, '@'), zip_with(split(__text, {email}, -1), regexp_extract_all(__text, {email}, 0), (p, m) -> struct(p, m)),
        array(named_struct('p', __text, 'm', cast(null as string))))"""
    terms_of = _let("parts", parts, f"flatten(zip_with(parts, {starts}, (q, base) -> {inside}))")
    both = f"array_sort(concat(spans, {terms_of}))"
    return joined.select(
        "doc_id", "__null", "__doc", "__text", F.when(F.col("__hits").isNull(), F.col("spans")).otherwise(F.expr(both)).alias("spans")
    )


def _listed(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts per kind, the digest of the base spans, and all spans as ``kind:start:end``."""
    spans = all_spans(docs, key, text)
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS) - 1)
    digest = F.sha2(_listed(base), 256).alias("base_sha256")
    return spans.select("doc_id", *counts[:-1], digest, _listed(F.col("spans")).alias("spans"), counts[-1])


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with every span generalised to its kind; all columns stay, ``n_chars`` follows the text if it is there.

    Where spans of two kinds overlap, the one that starts first (then by kind) covers both.
    """
    names = ", ".join(f"'{GENERAL[k]}'" for k in KINDS)
    # A part of the text from the blocks it lies in.
    part = f"""if(b <= a, '', substring(array_join(slice(__blocks, a div {BLOCK} + 1, (b - 1) div {BLOCK} - a div {BLOCK} + 1), ''), cast(a % {BLOCK} as int) + 1, b - a))"""

    def taken(a: str, b: str) -> str:
        return _let("b", b, _let("a", a, part))

    ends = _before("spans", "x.end", "greatest({a}, {b})")
    pieces = f"""zip_with(spans, {ends}, (s, at) -> if(s.end <= at, '', concat({taken('at', 's.start')}, if(s.start < at, '', array({names})[s.kind]))))"""
    rebuilt = f"concat(array_join({pieces}, ''), {taken('array_max(transform(spans, s -> s.end))', 'length(__text)')})"
    others = tuple(c for c in docs.columns if c != text)
    rows = all_spans(docs, key, text, others)
    blocks = F.when(F.size("spans") > 0, F.expr(f"regexp_extract_all(__text, '(?s).{{1,{BLOCK}}}', 0)"))
    rows = rows.withColumn("__blocks", blocks)
    hidden = F.when(F.col("__null"), F.lit(None)).when(F.size("spans") == 0, F.col("__text")).otherwise(F.expr(rebuilt))
    out = rows.select(hidden.alias("__out"), "__doc").select(F.col("__out").alias(text), *[F.col("__doc")[c].alias(c) for c in others])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
