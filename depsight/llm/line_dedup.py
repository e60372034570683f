"""Line dedup by a log-template tree, in DataFrame and SQL functions only.

Each line is parsed to a leaf of fixed depth: the number of its tokens, then its first LEAD tokens, with tokens that
hold a digit as the wildcard <*>. A leaf can hold many templates. Every token has a weight in its leaf: how often
documents have it at its place there. A line's template keeps its commonest tokens, at least ALIKE of them: those of
no less weight than the last of these; the others are variable fields. So lines that differ in a field share a
template, whatever else is in their leaf. Lines of fewer than MIN_TOKENS tokens, or whose kept tokens weigh less than
MIN_DOCS, are templates of their own. A template in MIN_DOCS documents or more recurs: its lines are dropped from all
documents but the one of smallest doc_id.

Counts are taken per document before they are shuffled and summed map-side, so a line that is in a third of all
documents is a few rows; documents meet only the list of their own templates to drop.

Defined results: null text is empty; empty and blank lines stay; lines repeated within one document count once, and
are dropped together; a document is an id and a text, so a repeated row is no further document, and another text under
the same id is one; rows of equal doc_id keep what the first document keeps; rows of null doc_id come before all
others; empty tables give an empty result; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, spool

MIN_DOCS, LEAD, MIN_TOKENS, ALIKE = 3, 3, 5, 0.7
NO_ID = -(1 << 63)

#: Tokens of a trimmed line; the plain split is the fast one.
_TOKENS = "if(instr(t, '  ') > 0 or instr(t, '\t') > 0, split(t, '[ \t]+'), split(t, ' '))"
#: Masked tokens: the wildcard for each that holds a digit.
_MASKED = f"if(t rlike '[0-9]', transform({_TOKENS}, w -> if(w rlike '[0-9]', '<*>', w)), {_TOKENS})"
#: Leaf and masked line of each line of a text, as hashes, in order; blank lines are null.
_LINES = f"""
transform(transform(split(text, '\n', -1), l -> trim(BOTH ' \t\r' FROM l)), t -> if(t = '', null,
  transform(array({_MASKED}), ws -> named_struct('leaf', xxhash64(size(ws), slice(ws, 1, {LEAD})), 'line', xxhash64(ws)))[0]))
"""
#: Tokens of the wanted lines, each hashed with its place and leaf.
_SIGNED = f"""
transform(filter(arrays_zip(l, ls), x -> x.ls is not null and array_contains(wanted, x.ls.line)),
  x -> named_struct('line', x.ls.line, 'at', transform(array(trim(BOTH ' \t\r' FROM x.l)), t -> transform({_MASKED}, (w, i) -> xxhash64(x.ls.leaf, i, w)))[0]))
"""
_KEY = ("doc", "th")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc and th identify a row by its id and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"), F.struct("*").alias("row"))


def _templates(texts: DataFrame, parsed: DataFrame, known: DataFrame, min_docs: int, alike: float) -> DataFrame:
    """line, template: of the lines that share a template's kept tokens with at least one more line, or might."""
    leaves = known.groupBy("leaf").agg(F.sum("docs").alias("leaf_docs"), F.count("*").alias("lines"))
    open_leaves = leaves.where((F.col("lines") > 1) & (F.col("leaf_docs") >= min_docs)).select("leaf")
    wanted = spool(known.join(open_leaves, "leaf").select("one", "line", "docs"))
    by_doc = wanted.groupBy("one.doc", "one.th").agg(F.collect_set("line").alias("wanted"))
    asked = spool(parsed.dropDuplicates(_KEY).join(by_doc, [*_KEY]))
    found = texts.select(*_KEY, "text").dropDuplicates(_KEY).join(asked, [*_KEY]).withColumn("l", F.split("text", "\n", -1)).select(F.explode(F.expr(_SIGNED)).alias("x"))
    found = found.select("x.*").where(F.size("at") >= MIN_TOKENS).dropDuplicates(["line"]).join(wanted.select("line", "docs"), "line")
    tokens = spool(found.select("line", "docs", F.explode("at").alias("at")))
    weights = tokens.groupBy("at").agg(F.sum("docs").alias("weight"))
    each = tokens.join(weights, "at").groupBy("line").agg(F.sort_array(F.collect_list(F.struct("weight", "at")), asc=False).alias("ts"))
    least = each.withColumn("least", F.element_at("ts", F.ceil(F.lit(alike) * F.size("ts")).cast("int"))["weight"]).where(F.col("least") >= min_docs)
    out = spool(least.select("line", F.xxhash64(F.array_sort(F.transform(F.filter("ts", lambda t: t["weight"] >= F.col("least")), lambda t: t["at"]))).alias("template")))
    free(wanted, asked, tokens)
    return out


def _gone(texts: DataFrame, parsed: DataFrame, min_docs: int, alike: float) -> DataFrame:
    """For each document with any: its lines of recurring templates that another document keeps."""
    lines = parsed.select(*_KEY, F.explode(F.array_distinct(F.filter("ls", lambda x: x.isNotNull()))).alias("l")).select(*_KEY, "l.*")
    known = spool(lines.groupBy("leaf", "line").agg(F.count("*").alias("docs"), F.min(F.struct(*_KEY)).alias("one")))
    templates = _templates(texts, parsed, known, min_docs, alike)
    own = known.join(templates, "line", "left").select("line", "docs", F.coalesce("template", F.xxhash64(F.lit("own"), "line")).alias("template"))
    own = spool(own)
    often = own.groupBy("template").agg(F.sum("docs").alias("all")).where(F.col("all") >= min_docs).select("template")
    held = spool(lines.select(*_KEY, "line").join(own.join(often, "template").select("line", "template"), "line"))
    free(known, templates, own)
    docs = held.select("template", *_KEY).distinct().groupBy("template").agg(F.count("*").alias("docs"), F.min("doc").alias("first")).where(F.col("docs") >= min_docs)
    out = spool(held.join(docs, "template").where("doc <> first").groupBy(*_KEY).agg(F.collect_set("line").alias("gone")))
    free(held)
    return out


def dropped(docs: DataFrame, min_docs: int = MIN_DOCS, alike: float = ALIKE) -> DataFrame:
    """The input's columns in struct ``row``, with ``text`` cleaned, n_lines and n_dropped."""
    texts = _keyed(docs)
    parsed = spool(texts.select(*_KEY, F.expr(_LINES).alias("ls")))
    gone = _gone(texts, parsed, min_docs, alike)
    by_doc = spool(parsed.dropDuplicates(_KEY).join(gone, [*_KEY]).select(*_KEY, "gone", F.transform("ls", lambda x: x["line"]).alias("hs")))
    free(parsed, gone)
    pairs = texts.join(by_doc, [*_KEY], "left").select("row", "text", F.split("text", "\n", -1).alias("ls"), "gone", "hs")
    stay = F.expr("transform(filter(arrays_zip(ls, hs), p -> p.hs is null or not array_contains(gone, p.hs)), p -> p.ls)")
    pairs = pairs.withColumn("stay", F.when(F.col("gone").isNotNull(), stay))
    return pairs.select("row", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join("stay", "\n")).alias("text"), F.size("ls").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("ls") - F.size("stay")).alias("n_dropped"))


def report(docs: DataFrame, min_docs: int = MIN_DOCS, alike: float = ALIKE) -> DataFrame:
    """doc_id, text without recurring lines, n_lines, n_dropped."""
    return dropped(docs, min_docs, alike).select(F.col("row.doc_id").cast("long").alias("doc_id"), "text", "n_lines", "n_dropped")


def cleaned(docs: DataFrame, min_docs: int = MIN_DOCS, alike: float = ALIKE) -> DataFrame:
    """The documents with their own columns; n_chars, if there, follows the text."""
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return dropped(docs, min_docs, alike).select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
