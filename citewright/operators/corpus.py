"""Building a corpus: cleaning, hierarchical parsing, amendments, chunking, splits and checks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from citewright.functions import text as T

# Patterns of the levels of a legal text, in the order they are tried.
CHAPTER = r"(?iu)^chương\s+([ivxlcdm]+)\b\.?\s*(.*)$"
SECTION = r"(?iu)^mục\s+(\d+)\b\.?\s*(.*)$"
ARTICLE = r"(?u)^Điều\s+(\d+[a-zđ]?)\.\s*(.*)$"
CLAUSE = r"^(\d+)\.\s+"
POINT = r"^([a-zđ])\)\s+"
APPENDIX = r"(?iu)^phụ lục(?:\s+([ivxlcdm\d]+))?\b\.?\s*(.*)$"


def explode_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, line_no, line): every line, line breaks of all kinds."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n|\r|\n")).alias("line_no", "line"))


def clean_lines(lines: DataFrame, key: str = "doc_id", boilerplate: tuple[str, ...] = T.BOILERPLATE_LINES, rules: tuple[tuple[str, str, str], ...] = T.RULES) -> DataFrame:
    """lines (key, line_no, line) normalised, less empty lines, lone marks, boilerplate and lines equal to the one kept before."""
    rows = lines.withColumn("line", T.normalize_line(F.col("line"), rules)).filter(~F.col("line").isin("", "-", "|"))
    rows = rows.filter(~F.regexp_replace(F.lower("line"), ":+$", "").isin(*boilerplate))
    before = F.lag("line").over(Window.partitionBy(key).orderBy("line_no"))
    return rows.withColumn("before", before).filter(~F.col("line").eqNullSafe(F.col("before"))).drop("before")


def cleaning_report(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(rule, hits): how often each rule changed or dropped a line."""
    hits = lines.agg(*[F.sum(c).alias(n) for c, (n, _, _) in zip(T.rule_hits(F.col("line")), T.RULES, strict=True)])
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(F.col(n), F.lit(0)).alias("hits")) for n, _, _ in T.RULES])).alias("x")
    kept = lines.withColumn("line", T.normalize_line(F.col("line"))).filter(~F.col("line").isin("", "-", "|"))
    boiler = F.regexp_replace(F.lower("line"), ":+$", "").isin(*T.BOILERPLATE_LINES)
    before = F.lag("line").over(Window.partitionBy(key).orderBy("line_no"))
    dropped = kept.agg(F.lit("drop_boilerplate_line").alias("rule"), F.coalesce(F.sum(boiler.cast("bigint")), F.lit(0)).alias("hits"))
    repeated = kept.filter(~boiler).withColumn("same", F.col("line").eqNullSafe(before)).agg(F.lit("drop_repeated_line").alias("rule"), F.coalesce(F.sum(F.col("same").cast("bigint")), F.lit(0)).alias("hits"))
    return hits.select(named).select("x.*").unionByName(dropped).unionByName(repeated)


def quoted(lines: DataFrame, key: str = "doc_id", opening: str = "“", closing: str = "”") -> DataFrame:
    """lines with in_quote: whether a quotation that an earlier line opened is still open."""
    last_open = F.length("line") - F.locate(opening, F.reverse("line"))
    last_close = F.length("line") - F.locate(closing, F.reverse("line"))
    has_open, has_close = F.locate(opening, F.col("line")) > 0, F.locate(closing, F.col("line")) > 0
    mark = F.when(has_open & (~has_close | (last_open > last_close)), True).when(has_close, False)
    state = F.last(mark, ignorenulls=True).over(Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    return lines.withColumn("in_quote", F.coalesce(state, F.lit(False)))


def parse_units(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """lines (key, line_no, line) to units (key, pos, level, chapter, section, article, article_title, clause, point, appendix, text).

    A line opens a level unless it stands inside a quotation; lower levels end where a
    higher one opens; other lines continue the unit. What comes before the first
    heading is skipped. Inside an appendix nothing but an appendix opens. A unit
    without text is dropped, except an article.
    """
    order = Window.partitionBy(key).orderBy("line_no")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    free = ~F.col("in_quote")
    level = F.when(~free, None)
    for name, pattern in (("appendix", APPENDIX), ("chapter", CHAPTER), ("section", SECTION), ("article", ARTICLE), ("clause", CLAUSE), ("point", POINT)):
        level = level.when(F.col("line").rlike(pattern), F.lit(name))
    rows = quoted(lines, key).withColumn("opens", level)
    rows = rows.withColumn("appendices", F.sum((F.col("opens") == "appendix").cast("int")).over(upto))
    rows = rows.withColumn("opens", F.when((F.coalesce("appendices", F.lit(0)) > 0) & (F.col("opens") != "appendix"), None).otherwise(F.col("opens")))
    number = {"chapter": (CHAPTER, 1), "section": (SECTION, 1), "article": (ARTICLE, 1), "clause": (CLAUSE, 1), "point": (POINT, 1), "appendix": (APPENDIX, 1)}
    scope: list[str] = [key]
    for name in ("appendix", "chapter", "section", "article", "clause", "point"):
        pattern, group = number[name]
        within = Window.partitionBy(*scope).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
        value = F.when(F.col("opens") == name, F.regexp_extract("line", pattern, group))
        rows = rows.withColumn(name, F.last(value, ignorenulls=True).over(within))
        if name == "article":
            rows = rows.withColumn("article_title", F.last(F.when(F.col("opens") == name, F.regexp_extract("line", pattern, 2)), ignorenulls=True).over(within))
        rows = rows.withColumn(f"n_{name}", F.sum(F.coalesce((F.col("opens") == name).cast("int"), F.lit(0))).over(within))
        # a section belongs to its chapter, an article to neither: its number runs through the text
        scope = {"appendix": [key, "n_appendix"], "chapter": [key, "n_appendix", "n_chapter"], "section": [key, "n_appendix"]}.get(name, [*scope, f"n_{name}"])
    unit = F.sum(F.col("opens").isNotNull().cast("int")).over(upto)
    body = F.when(F.col("opens").isin("clause", "point"), F.regexp_replace("line", rf"{CLAUSE}|{POINT}", "")).when(F.col("opens").isNotNull(), F.lit("")).otherwise(F.col("line"))
    units = rows.withColumns({"pos": unit, "body": body}).filter("pos > 0").groupBy(key, "pos").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("opens",)], *[F.min_by(c, "line_no").alias(c) for c in ("chapter", "section", "article", "article_title", "clause", "point", "appendix")],
        F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "body"))), lambda x: x["body"]), lambda x: x != ""), "\n").alias("text"),
    )
    units = units.withColumnRenamed("opens", "level").filter("level not in ('chapter', 'section')")
    return units.filter("text != '' or level = 'article'")


def article_counts_differ(units: DataFrame, expected: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents whose number of articles is not the expected (key, n_articles)."""
    found = units.filter("article is not null").groupBy(key).agg(F.countDistinct("article").alias("found"))
    return expected.join(found, key, "left").withColumn("found", F.coalesce("found", F.lit(0))).filter("found != n_articles")


@dataclass
class Amendment:
    """One dated operation: replace, insert, repeal, remove_phrase or rename."""

    id: str
    op: str
    doc: str
    article: str
    effective: str
    clause: str | None = None
    point: str | None = None
    lines: list[str] = field(default_factory=list)
    phrase: str | None = None
    title: str | None = None
    after_clause: str | None = None
    after_article: str | None = None


def apply_amendments(units: DataFrame, log: list[Amendment]) -> tuple[DataFrame, DataFrame]:
    """(units in force, log rows): operations by effective date, then place in the log; each sees the ones before.

    units: (doc_id, pos double, article, article_title, clause, point, text). The
    result adds status, amended_by and effective_from. A target that does not
    exist, an insert that does and a phrase that is not found are errors in the log
    rows (id, op, ok, n_units, error); the units stay as they were.
    The log is short by nature; each operation is one conditional projection.
    """
    spark = units.sparkSession
    rows = units.withColumns({"pos": F.col("pos").cast("double"), "status": F.lit("active"), "amended_by": F.array().cast("array<string>"), "effective_from": F.lit(None).cast("date")})
    notes: list[tuple] = []
    for op in sorted(log, key=lambda a: a.effective):
        at_article = F.col("doc_id").eqNullSafe(F.lit(op.doc)) & F.col("article").eqNullSafe(F.lit(op.article))
        target = at_article
        for name in ("clause", "point"):
            if getattr(op, name) is not None:
                target = target & F.col(name).eqNullSafe(F.lit(getattr(op, name)))
        stamp = {"amended_by": F.when(target, F.array_append("amended_by", F.lit(op.id))).otherwise(F.col("amended_by")), "effective_from": F.when(target, F.lit(op.effective).cast("date")).otherwise(F.col("effective_from"))}
        if op.op == "insert":
            anchor = F.col("doc_id").eqNullSafe(F.lit(op.doc)) & (F.col("article").eqNullSafe(F.lit(op.after_article)) if op.after_article else F.col("article").eqNullSafe(F.lit(op.article)) & F.col("clause").eqNullSafe(F.lit(op.after_clause)))
            found = rows.agg(F.count(F.when(target, 1)).alias("n"), F.max(F.when(anchor, F.col("pos"))).alias("after")).first()
            error = "target exists" if found["n"] else None if found["after"] is not None else "no unit to insert after"
        else:
            pattern = r"(?iu)" + r"\s*".join(_quoted(w) for w in (op.phrase or "").split())
            hit = target & F.col("text").rlike(pattern) if op.op == "remove_phrase" else target
            found = rows.agg(F.count(F.when(hit, 1)).alias("n"), F.min(F.when(target, F.col("pos"))).alias("first")).first()
            error = None if found["n"] else "phrase not found" if op.op == "remove_phrase" else "no such unit"
        n = len(op.lines) if op.op == "insert" else found["n"]
        notes.append((op.id, op.op, error is None, int(n if error is None else 0), error))
        if error:
            continue
        if op.op == "repeal":
            rows = rows.withColumns({**stamp, "status": F.when(target, F.lit("repealed")).otherwise(F.col("status"))})
        elif op.op == "remove_phrase":
            cut_ = F.trim(F.regexp_replace(F.regexp_replace("text", pattern, ""), r" {2,}", " "))
            rows = rows.withColumns({**stamp, "text": F.when(target, cut_).otherwise(F.col("text"))})
        elif op.op == "rename":
            first = F.col("pos") == found["first"]
            stamp = {"amended_by": F.when(first, F.array_append("amended_by", F.lit(op.id))).otherwise(F.col("amended_by")), "effective_from": F.when(first, F.lit(op.effective).cast("date")).otherwise(F.col("effective_from"))}
            rows = rows.withColumns({**stamp, "article_title": F.when(at_article, F.lit(op.title)).otherwise(F.col("article_title"))})
        elif op.op == "replace" and op.point is not None:
            rows = rows.withColumns({**stamp, "text": F.when(target, F.lit("\n".join(op.lines))).otherwise(F.col("text"))})
        else:
            history = [] if op.op == "insert" else (rows.filter(target).agg(F.array_distinct(F.flatten(F.collect_list("amended_by"))).alias("h")).first()["h"] or [])
            start = found["after"] if op.op == "insert" else found["first"]
            step = 1.0 / (1 << 20)
            block = [
                (op.doc, start + (step * (i + 1) if op.op == "insert" else step * i), op.article, u["title"], u["clause"], u["point"], u["text"], "active", [*history, op.id], op.effective)
                for i, u in enumerate(split_block(op.lines, op))
            ]
            made = spark.createDataFrame(block, "doc_id string, pos double, article string, article_title string, clause string, point string, text string, status string, amended_by array<string>, effective_from string")
            made = made.withColumn("effective_from", F.col("effective_from").cast("date"))
            titles = rows.filter(at_article).agg(F.first("article_title", ignorenulls=True).alias("t"))
            made = made.crossJoin(F.broadcast(titles)).withColumn("article_title", F.coalesce("article_title", "t")).drop("t")
            rows = (rows if op.op == "insert" else rows.filter(~target)).unionByName(made, allowMissingColumns=True)
    return rows, spark.createDataFrame(notes, "id string, op string, ok boolean, n_units int, error string")


def _quoted(word: str) -> str:
    return "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in word)


def split_block(lines: list[str], base: Amendment) -> Iterator[dict]:
    """Units of an inserted or replacing block; lines before any clause belong to the base address."""
    title, clause, point, held = base.title, base.clause, base.point, []
    opened = False

    def unit() -> dict:
        return {"title": title, "clause": clause, "point": point, "text": "\n".join(held)}

    for line in lines:
        if m := re.match(r"Điều\s+\d+[a-zđ]?\.\s*(.*)$", line):
            title, opened = m[1], True
        elif m := re.match(CLAUSE, line) or re.match(POINT, line):
            if held or (opened and clause is not None):
                yield unit()
            held = [line[m.end() :]]
            clause, point = (m[1], None) if m[1].isdigit() else (clause, m[1])
            opened = True
        else:
            held.append(line)
    if held or opened:
        yield unit()


def in_force(units: DataFrame) -> DataFrame:
    return units.filter("status != 'repealed'")


def pack_pieces(pieces: Column, most: int) -> Column:
    """Greedy packing of an array of texts into parts of at most ``most`` tokens (split at spaces), in one fold.

    A piece that is too long alone becomes a part of its own; ``halve`` cuts such pieces first.
    """
    size = lambda p: F.size(F.filter(F.split(p, r"\s+"), lambda w: w != ""))
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("used"))

    def step(s: Column, p: Column) -> Column:
        n = size(p)
        fits = (F.size(s["parts"]) > 0) & (s["used"] + n <= most)
        joined = F.concat(F.slice(s["parts"], F.lit(1), F.size(s["parts"]) - 1), F.array(F.concat_ws(" ", F.element_at(s["parts"], -1), p)))
        return F.when(fits, F.struct(joined.alias("parts"), (s["used"] + n).alias("used"))).otherwise(F.struct(F.array_append(s["parts"], p).alias("parts"), n.alias("used")))

    return F.aggregate(pieces, start, step, lambda s: s["parts"])


def halve(piece: str, most: int) -> list[str]:
    """A piece of more than ``most`` words as halves, again and again."""
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", piece) if w]
    if len(words) <= most:
        return [piece]
    middle = len(words) // 2
    return halve(" ".join(words[:middle]), most) + halve(" ".join(words[middle:]), most)


def chunk_texts(docs: DataFrame, most: int = 200, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(chunk_id, key, part, n_parts, n_tokens, chunk_text): sentences packed greedily, long ones halved by words first."""

    @F.pandas_udf(ArrayType(StringType()))
    def fitting(sentences: pd.Series) -> pd.Series:
        return sentences.map(lambda xs: [y for x in (xs if xs is not None else []) for y in halve(x, most)])

    flat = F.regexp_replace(F.trim(F.coalesce(F.col(text), F.lit(""))), r"\s+", " ")
    parts = docs.select(key, fitting(T.split_sentences(flat)).alias("pieces")).select(key, pack_pieces(F.col("pieces"), most).alias("parts"))
    rows = parts.select(key, F.size("parts").alias("n_parts"), F.posexplode("parts").alias("part", "chunk_text"))
    size = F.size(F.filter(F.split("chunk_text", r"\s+"), lambda w: w != ""))
    name = F.concat(F.col(key).cast("string"), F.when(F.col("n_parts") > 1, F.concat(F.lit("__P"), (F.col("part") + 1).cast("string"))).otherwise(F.lit("")))
    return rows.select(name.alias("chunk_id"), key, (F.col("part") + 1).alias("part"), "n_parts", size.alias("n_tokens"), "chunk_text")


def check_chunks(chunks: DataFrame, most: int = 200) -> DataFrame:
    """(rule, chunk_id) of chunks with a repeated id, no text, too many tokens or another's text."""
    one = lambda rule, rows: rows.select(F.lit(rule).alias("rule"), "chunk_id")
    repeated = lambda c: chunks.join(chunks.groupBy(c).count().filter("count > 1"), c, "left_semi")
    return (
        one("repeated id", repeated("chunk_id")).unionByName(one("empty", chunks.filter("trim(chunk_text) = ''")))
        .unionByName(one("too long", chunks.filter(F.col("n_tokens") > most))).unionByName(one("repeated text", repeated("chunk_text")))
    )


def wanted(units: DataFrame, rules: DataFrame) -> DataFrame:
    """Units that a rule (doc_id, article?, clause?) includes: null levels include everything below."""
    r = rules.select(F.col("doc_id").alias("d"), F.col("article").alias("a"), F.col("clause").alias("c")).distinct()
    match = (F.col("doc_id") == F.col("d")) & (F.col("a").isNull() | F.col("article").eqNullSafe(F.col("a"))) & (F.col("c").isNull() | F.col("clause").eqNullSafe(F.col("c")))
    return units.join(F.broadcast(r), match, "left_semi")  # rules are written by hand


def allocation(n: Column, shares: tuple[float, float, float] = (0.4, 0.2, 0.4)) -> Column:
    """[train, validation, test] of n groups by largest remainder; at least one each in the last two from n = 3 on."""
    whole = [F.floor(n * s).cast("int") for s in shares]
    rest = n - sum(whole[1:], whole[0])
    part = [n * s - w for s, w in zip(shares, whole, strict=True)]
    order = [sum(((part[j] > part[i]) | ((part[j] == part[i]) & F.lit(j < i))).cast("int") for j in range(3) if j != i) for i in range(3)]
    got = [w + (o < rest).cast("int") for w, o in zip(whole, order, strict=True)]
    lacking = [F.when((n >= 3) & (got[i] == 0), 1).otherwise(0) for i in (1, 2)]
    return F.array(got[0] - lacking[0] - lacking[1], got[1] + lacking[0], got[2] + lacking[1])


def _by_hash(groups: DataFrame, seed: int, kind: str, group: str) -> DataFrame:
    """groups with nth, the place from 1 in the order of a hash within their kind, and n, the kind's size.

    The hash's first digits are a bucket; buckets are counted, so no task orders a whole kind.
    """
    rows = groups.withColumn("__h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string")))).withColumn("__b", F.left("__h", F.lit(3)))
    counts = rows.groupBy(kind, "__b").agg(F.count("*").alias("__c"))
    w = Window.partitionBy(kind)
    before = counts.select(kind, "__b", (F.sum("__c").over(w.orderBy("__b")) - F.col("__c")).alias("__before"), F.sum("__c").over(w).cast("int").alias("n"))
    nth = F.row_number().over(Window.partitionBy(kind, "__b").orderBy("__h", group))
    placed = rows.withColumn("__nth", nth).join(before, [kind, "__b"])
    return placed.withColumn("nth", (F.col("__before") + F.col("__nth")).cast("int")).drop("__h", "__b", "__nth", "__before")


def group_split(groups: DataFrame, seed: int = 42, kind: str = "kind", group: str = "group_id") -> DataFrame:
    """groups with split: train, validation or test by hash order within each kind, in the shares of ``allocation``."""
    columns = groups.columns
    a = allocation(F.col("n"))
    split = F.when(F.col("nth") <= a[0], "train").when(F.col("nth") <= a[0] + a[1], "validation").otherwise("test")
    return _by_hash(groups, seed, kind, group).withColumn("split", split).select(*columns, "split")


def double_sample(groups: DataFrame, share: float = 0.2, seed: int = 42, kind: str = "kind", group: str = "group_id", people: int = 3) -> DataFrame:
    """A share of each kind's groups, at least one, by hash order; with two labelers in turn after the writer."""
    chosen = _by_hash(groups, seed, kind, group).filter(F.col("nth") <= F.greatest(F.lit(1), F.bround(share * F.col("n")).cast("int")))
    writer = F.pmod(F.col("nth") - 1, F.lit(people))
    return chosen.select(kind, group, (writer + 1).cast("int").alias("writer"), (F.pmod(writer + 1, F.lit(people)) + 1).cast("int").alias("labeler_1"), (F.pmod(writer + 2, F.lit(people)) + 1).cast("int").alias("labeler_2"))


def numbering_ok(articles: DataFrame, key: str = "doc_id", number: str = "article") -> DataFrame:
    """(key, ok): whether the numbers that are digits only run from 1 without a gap."""
    digits = articles.filter(F.col(number).rlike(r"^\d+$")).groupBy(key).agg(F.countDistinct(F.col(number).cast("int")).alias("n"), F.min(F.col(number).cast("int")).alias("low"), F.max(F.col(number).cast("int")).alias("high"))
    return digits.select(key, ((F.col("low") == 1) & (F.col("high") == F.col("n"))).alias("ok"))


def foreign_keys(checks: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(severity, rule, key) for each key of the first table without a match in the second: [(rule, rows, column, in rows, column)]."""
    out = None
    for rule, rows, column, other, match in checks:
        missing = rows.filter(F.col(column).isNotNull()).join(other.select(F.col(match).alias("__m")).distinct(), F.col(column) == F.col("__m"), "left_anti")
        part = missing.select(F.lit("error").alias("severity"), F.lit(rule).alias("rule"), F.col(column).cast("string").alias("key")).distinct()
        out = part if out is None else out.unionByName(part)
    return out
