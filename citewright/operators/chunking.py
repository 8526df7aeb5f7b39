"""Chunks of articles with their provenance: whole where they fit, else by clause, else packed from points and sentences."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from citewright.functions import text as T
from citewright.operators.corpus import halve, in_force, wanted

_BLANK = re.compile(r"[ \t\n\x0b\f\r]+")
_SENTENCE_END = re.compile(r"(?<=[.;:])[ \t\n\x0b\f\r]+")
# Words of the headers that the chunks carry, and names of kinds of documents.
ARTICLE_WORD, CLAUSE_WORD, PART_WORD, APPENDIX_WORD = "Điều", "Khoản", "phần", "Phụ lục"
DOCUMENT_KINDS = {"QH": "Luật Hộ tịch", "ND-CP": "Nghị định", "TT-BTP": "Thông tư"}


def n_tokens(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def short_name(doc_id: Column) -> Column:
    """number.year.kind as the document is cited; an id of another form stays."""
    parts = F.split(doc_id, r"\.", 3)
    kind = F.get(parts, F.lit(2))
    written = F.concat(F.get(parts, F.lit(0)), F.lit("/"), F.get(parts, F.lit(1)), F.lit("/"), F.regexp_replace(kind, "^ND-", "NĐ-"))
    named = F.when(kind.startswith("QH"), F.lit(DOCUMENT_KINDS["QH"]))
    for code in ("ND-CP", "TT-BTP"):
        named = named.when(kind == code, F.lit(DOCUMENT_KINDS[code]))
    return F.coalesce(F.concat(named, F.lit(" "), written), doc_id)


@F.pandas_udf(ArrayType(StructType([StructField("text", StringType()), StructField("opens", BooleanType()), StructField("closes", BooleanType())])))
def fitted(pieces: pd.Series, room: pd.Series) -> pd.Series:
    """Pieces that have at most ``room`` words each: a longer one as its sentences, a longer sentence as halves of halves.

    What comes of a longer piece shares no part with its neighbours, and a half none with anything.
    """
    size = lambda t: len([w for w in _BLANK.split(t) if w])

    def cut(piece: str, most: int) -> list[dict]:
        if size(piece) <= most:
            return [{"text": piece, "opens": False, "closes": False}]
        sentences = [s for s in _SENTENCE_END.split(piece) if s]
        out = []
        for s in sentences:
            short = size(s) <= most
            out += [{"text": x, "opens": not short, "closes": not short} for x in ([s] if short else halve(s, most))]
        out[0]["opens"] = out[-1]["closes"] = True
        return out

    return pd.Series([[x for p in (ps if ps is not None else ()) for x in cut(p, max(1, int(n)))] for ps, n in zip(pieces, room, strict=True)])


def packed(pieces: Column, room: Column, between: Column) -> Column:
    """Parts, in order, of at most ``room`` words: a piece joins the part before it where it fits and neither stands alone."""
    none = F.array().cast("array<struct<text:string,used:int,closed:boolean>>")

    def step(done: Column, p: Column) -> Column:
        last, n = F.try_element_at(done, F.lit(-1)), n_tokens(p["text"])
        joins = F.coalesce(~last["closed"] & ~p["opens"] & (last["used"] + n <= room), F.lit(False))
        one = F.struct(F.concat(last["text"], between, p["text"]).alias("text"), (last["used"] + n).alias("used"), p["closes"].alias("closed"))
        new = F.struct(p["text"].alias("text"), n.alias("used"), p["closes"].alias("closed"))
        return F.when(joins, F.array_append(F.slice(done, F.lit(1), F.size(done) - 1), one)).otherwise(F.array_append(done, new))

    return F.transform(F.aggregate(pieces, none, step), lambda x: x["text"])


def group_units(units: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Articles, and appendices, of the units in force that the rules want, each with its units in order.

    units: (doc_id, pos, article, article_title, clause, point, text[, chapter, section, appendix,
    status, amended_by, effective_from]). Gives (doc_id, key, article, title, partial, intro, clauses, ops,
    effective_from, pos): intro has the lines before any clause, clauses the lines of each, in the
    order they appear. An article of which the rules take some clauses only is partial.
    """
    present = set(units.columns)
    kind = {"amended_by": "array<string>", "effective_from": "date", "appendix": "string", "status": "string"}
    rows = units.withColumns({c: F.lit(None).cast(t) for c, t in kind.items() if c not in present})
    rows = in_force(rows.withColumn("status", F.coalesce("status", F.lit("active"))))
    rows = rows.withColumn("partial", F.lit(False))
    if rules is not None:
        whole = rules.filter("clause is null").select(F.col("doc_id").alias("d"), F.col("article").alias("a")).distinct()
        match = (F.col("doc_id") == F.col("d")) & (F.col("a").isNull() | F.col("article").eqNullSafe(F.col("a")))
        rows = wanted(rows, rules)
        full = rows.select("doc_id", "article").distinct().join(F.broadcast(whole), match, "left_semi").withColumn("full", F.lit(True))  # rules are written by hand
        rows = rows.join(full.withColumnsRenamed({"doc_id": "__d", "article": "__a"}), F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("article").eqNullSafe(F.col("__a")), "left")
        rows = rows.withColumn("partial", F.col("full").isNull()).drop("full", "__d", "__a")
    name = F.coalesce(F.concat(F.lit("D"), F.col("article")), F.concat(F.lit("PL"), F.col("appendix")))
    title = F.when(F.col("article").isNotNull(), F.trim(F.concat(F.lit(f"{ARTICLE_WORD} "), F.col("article"), F.lit(". "), F.coalesce("article_title", F.lit(""))))).otherwise(F.concat(F.lit(f"{APPENDIX_WORD} "), F.col("appendix")))
    line = F.when(F.col("point").isNotNull(), F.concat(F.col("point"), F.lit(") "), F.col("text"))).otherwise(F.col("text"))
    rows = rows.withColumns({"key": name, "title": title, "line": line}).filter("key is not null")
    texts = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("line") != "", F.struct("pos", "line")))), lambda x: x["line"]).alias(c)
    of_clause = rows.groupBy("doc_id", "key", "clause").agg(
        F.min("pos").alias("at"), texts("lines"), F.flatten(F.collect_list("amended_by")).alias("ops"), F.max("effective_from").alias("effective_from"), F.first("article").alias("article"),
        F.min_by("title", "pos").alias("title"), F.max("partial").alias("partial"),
    )
    clauses = F.filter(F.array_sort(F.collect_list(F.struct("at", "clause", "lines"))), lambda c: c["clause"].isNotNull() & (F.size(c["lines"]) > 0))
    groups = of_clause.groupBy("doc_id", "key").agg(
        F.first("article").alias("article"), F.min_by("title", "at").alias("title"), F.max("partial").alias("partial"), F.flatten(F.collect_list(F.when(F.col("clause").isNull(), F.col("lines")))).alias("intro"),
        clauses.alias("clauses"), F.flatten(F.collect_list("ops")).alias("ops"), F.max("effective_from").alias("effective_from"), F.min("at").alias("pos"),
    )
    return groups.filter((F.size("intro") > 0) | (F.size("clauses") > 0))


def chunk_groups(groups: DataFrame, most: int = 256, title: Callable[[Column], Column] = short_name) -> DataFrame:
    """groups as ``group_units`` gives them, by chunk: suffix, clause, part, header and body, header and body of at most ``most`` words.

    An article that fits, and is not partial, is one chunk. Without clauses it is packed from its
    sentences. Else each clause is one, the first with what comes before it, or is packed from its
    lead and its points, with room for the number of the part.
    """
    head = F.concat(title(F.col("doc_id")), F.lit(" | "), F.col("title"))
    lines = F.concat(F.col("intro"), F.flatten(F.transform("clauses", lambda c: c["lines"])))
    rows = groups.withColumns({"header": head, "body": F.array_join(lines, "\n")})
    fits = n_tokens(F.col("header")) + n_tokens(F.col("body")) <= most
    whole = rows.filter(~F.col("partial") & fits)
    rest = rows.filter(F.col("partial") | ~fits)
    kept = groups.columns
    none = {"suffix": F.lit(""), "clause": F.lit(None).cast("string"), "part": F.lit(None).cast("int")}
    columns = [*kept, *none, "header", "body"]
    whole = whole.withColumns(none).select(columns)

    flat = rest.filter(F.size("clauses") == 0)
    flat = flat.withColumns({**none, "pieces": T.split_sentences(F.array_join("intro", "\n")), "between": F.lit(" "), "reserve": F.col("header"), "numbered": F.lit(False)})

    each = rest.select(*kept, "header", F.posexplode("clauses").alias("n", "c"))
    own = F.when((F.col("n") == 0) & ~F.col("partial"), F.concat("intro", "c.lines")).otherwise(F.col("c.lines"))
    each = each.withColumns({**none, "clause": F.col("c.clause"), "suffix": F.concat(F.lit("__K"), F.col("c.clause")), "own": own, "header": F.concat(F.col("header"), F.lit(f" | {CLAUSE_WORD} "), F.col("c.clause"))})
    each = each.withColumn("body", F.array_join("own", "\n"))
    clause_fits = n_tokens(F.col("header")) + n_tokens(F.col("body")) <= most
    point = r"^[a-zđ]\)\s+"
    opens = F.filter(F.transform("own", lambda x, i: F.when(x.rlike(point), i)), lambda i: i.isNotNull())
    starts = F.array_distinct(F.concat(F.when(F.get(opens, F.lit(0)).eqNullSafe(F.lit(0)), F.array().cast("array<int>")).otherwise(F.array(F.lit(0))), opens))
    ends = F.concat(F.slice(starts, F.lit(2), F.size("own") + 1), F.array(F.size("own")))
    pieces = F.zip_with(starts, ends, lambda a, b: F.array_join(F.slice(F.col("own"), a + 1, b - a), "\n"))
    long = each.filter(~clause_fits).withColumns({"pieces": pieces, "between": F.lit("\n"), "reserve": F.concat(F.col("header"), F.lit(f" ({PART_WORD} 9)")), "numbered": F.lit(True)})

    shared = [*kept, "suffix", "clause", "header", "pieces", "between", "reserve", "numbered"]
    several = flat.select(shared).unionByName(long.select(shared)).withColumn("room", most - n_tokens(F.col("reserve")))
    several = several.withColumn("parts", packed(fitted("pieces", "room"), F.greatest(F.col("room"), F.lit(1)), F.col("between")))
    several = several.select("*", F.posexplode("parts").alias("i", "body")).withColumn("part", F.col("i") + 1)
    several = several.withColumns({"suffix": F.concat(F.col("suffix"), F.lit("__P"), F.col("part").cast("string")), "header": F.when(F.col("numbered"), F.concat(F.col("header"), F.lit(f" ({PART_WORD} "), F.col("part").cast("string"), F.lit(")"))).otherwise(F.col("header"))})
    return whole.unionByName(each.filter(clause_fits).select(columns)).unionByName(several.select(columns))


def provenance(groups: DataFrame, op_docs: DataFrame) -> DataFrame:
    """(doc_id, key, amended_by, amendment_ops): the operations on each group, and the documents they are from; an unknown operation stands for its document."""
    ops = groups.select("doc_id", "key", F.explode(F.array_distinct("ops")).alias("op"))
    named = ops.join(op_docs.select("op", "amending_doc"), "op", "left")
    return named.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.coalesce("amending_doc", "op"))).alias("amended_by"), F.array_sort(F.collect_set("op")).alias("amendment_ops"))


def build_chunks(
    units: DataFrame, sources: DataFrame, op_docs: DataFrame, most: int = 256, rules: DataFrame | None = None, title: Callable[[Column], Column] = short_name, segment: Callable[[Column], Column] | None = None
) -> DataFrame:
    """The chunks of all articles, with id, texts, provenance and the source's url, access date and documents affected.

    sources: (doc_id, url, accessed_at, affected_by), the last divided by semicolons; op_docs: (op,
    amending_doc). ``segment`` joins the syllables of words, for ``text_seg`` and the count of tokens.
    """
    groups = group_units(units, rules)
    none = F.array().cast("array<string>")
    rows = chunk_groups(groups, most, title).join(provenance(groups, op_docs), ["doc_id", "key"], "left").join(sources, "doc_id", "left")
    text = F.concat("header", F.lit("\n"), "body")
    seg = segment(text) if segment else text
    return rows.select(
        F.concat(F.col("doc_id"), F.lit("__"), F.col("key"), F.col("suffix")).alias("chunk_id"), "doc_id", title(F.col("doc_id")).alias("doc_title"), F.coalesce("article", "key").alias("article"), F.col("title").alias("article_title"),
        "clause", "part", text.alias("chunk_text"), F.col("body").alias("display_text"), seg.alias("text_seg"), n_tokens(seg).alias("n_tokens"), F.coalesce("amended_by", none).alias("amended_by"), F.coalesce("amendment_ops", none).alias("amendment_ops"),
        F.filter(F.split(F.coalesce("affected_by", F.lit("")), ";"), lambda x: x != "").alias("affected_by"), "effective_from", "url", "accessed_at",
    )
