"""Language identification by Bayesian fusion of evidence.

The text's likelihood under each language comes from byte trigrams; to it are added what the markup declares, the
address's suffix and the prior of the host.  Host priors are smoothed hierarchically - host, registered domain, all
rows - by grouped aggregation of the texts' own verdicts, with a row's own verdict taken out of its prior.  How much a
declaration or a suffix says about a language is counted in the same way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phaselens.llm.runtime import settle, slices

TABLE = 1 << 16
#: Trigrams count as if a text had this many times the square root of its number: neighbours aren't independent.
WEIGHT = 3.0
#: Rows of a level that count as much as the level above.
SMOOTHING = 5.0
#: Shares that a host's rows are dealt into, as one host may have a third of all.
SHARES = 32


@dataclass
class TextModel:
    """Log probabilities of hashed trigrams, TABLE rows and a column for each language."""

    languages: list[str]
    logp: np.ndarray


def _trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all trigrams of the lower-cased texts, whose other characters than letters are one space, and where each text's begin."""
    raw = np.frombuffer(b"".join(b"  " + t.lower() + b" " for t in texts), np.uint8)
    letter = ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    sizes = np.array([len(t) + 3 for t in texts])
    ends = np.cumsum(sizes)
    folded = np.where(letter, raw, 32).astype(np.uint32)
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # the first character after a word
    kept[ends - sizes + 1] = True
    at = np.cumsum(kept)
    starts = np.concatenate([[0], at[ends - 1]])
    c = folded[kept]
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    h = ((c[:-2] << 16 | c[1:-1] << 8 | c[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    owner = np.searchsorted(starts, np.arange(len(h)), "right") - 1
    inside = np.arange(len(h)) + 2 < starts[owner + 1]
    count = np.bincount(owner[inside], minlength=len(texts))
    return h[inside].astype(np.int64), np.concatenate([[0], np.cumsum(count)])


def train(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", rows: int = 6000) -> TextModel:
    """Fit trigram models on at most ``rows`` labelled rows, those with the smallest hashes of their keys, and of all their languages.

    Rows without text or label don't count.  Whole texts are read; what reaches the driver is a table of fixed size for each language.
    """
    rank = F.xxhash64(key)
    usable = labelled.where(F.col(text).isNotNull() & F.col(label).isNotNull())
    some = usable.select(rank.alias("h"), F.col(label).cast("string").alias("l"))
    sample = some.orderBy("h", "l").limit(rows).groupBy("l").agg(F.max("h").alias("top")).collect()
    languages = sorted(r["l"] for r in sample)
    if not languages:
        return TextModel([], np.zeros((TABLE, 0), np.float32))
    limit = max(r["top"] for r in sample)
    chosen = usable.where((rank <= limit) & F.col(label).isin(languages)).select(F.col(label).cast("string").alias("l"), F.col(text).cast("binary").alias("_text"))
    # equal keys have one rank: where they are more than the bound leaves room for, the texts' hashes say which are taken, in each run alike
    if usable.where(rank <= limit).count() > rows:
        chosen = usable.where((rank <= limit) & F.col(label).isin(languages)).orderBy(rank, F.xxhash64(text), F.col(label).cast("string")).limit(rows).select(F.col(label).cast("string").alias("l"), F.col(text).cast("binary").alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        at = {x: k for k, x in enumerate(languages)}
        for b in slices(batches, "_text"):
            h, starts = _trigrams([t or b"" for t in b.column("_text").to_pylist()])
            row = np.repeat(np.array([at[x] for x in b.column("l").to_pylist()]), np.diff(starts))
            for k in np.unique(row).tolist():
                counts = np.bincount(h[row == k], minlength=TABLE)
                total[k] = total[k] + counts if k in total else counts
        for k, counts in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([counts.tobytes()], pa.binary())], names=["k", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_py(), np.int64) for c in group.column("counts"))
        return pa.table({"k": group.column("k")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    total = np.zeros((len(languages), TABLE))
    for r in chosen.mapInArrow(count, "k int, counts binary").groupBy("k").applyInArrow(add, "k int, counts binary").collect():
        total[r["k"]] = np.frombuffer(r["counts"], np.int64)
    logp = np.log((total + 0.1) / (total + 0.1).sum(1, keepdims=True))
    return TextModel(languages, np.ascontiguousarray(logp.T, np.float32))


def likelihoods(df: DataFrame, model: TextModel, text: Column, keep: list[Column]) -> DataFrame:
    """``keep`` (aliased columns), _n (trigrams of the text) and _ll (a log likelihood for each language, weighted for dependence)."""
    width = len(model.languages)
    table = df.sparkSession.sparkContext.broadcast(model.logp)
    chosen = df.select(*keep, text.cast("binary").alias("_text"))
    fields = [f for f in chosen.schema.fields if f.name != "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logp = table.value
        for b in slices(batches, "_text"):
            h, starts = _trigrams([t or b"" for t in b.column("_text").to_pylist()])
            n = np.diff(starts)
            total = np.zeros((b.num_rows, width))
            for k in range(width):
                total[:, k] = np.diff(np.concatenate([[0.0], np.cumsum(logp[h, k], dtype=np.float64)])[starts])
            weight = np.minimum(n, WEIGHT * np.sqrt(n)) / np.maximum(n, 1)
            total *= weight[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, total.size + 1, width) if width else np.zeros(b.num_rows + 1), pa.int32()), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in fields), pa.array(n, pa.int64()), lists], names=[*(f.name for f in fields), "_n", "_ll"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return chosen.mapInArrow(run, f"{schema}, _n long, _ll array<double>")


@dataclass(frozen=True)
class Evidence:
    """Expressions for what a row offers beside its text; None where there is nothing of the kind."""

    host: Column | None = None
    declared: Column | None = None
    suffix: Column | None = None


def identify(df: DataFrame, model: TextModel, evidence: Evidence, keep: list[str], text: str | Column = "text", least: float = 0.4) -> DataFrame:
    """Columns ``keep``, then lang, confidence (its posterior), text_lang (by the text alone), accepted.

    Texts without letters, and all texts when the model has no language, have a null lang and aren't accepted; others are if the
    posterior is ``least`` or more and the text itself is likelier under its language than if all trigrams were alike.  Null hosts, declarations and suffixes say nothing.  Repeated rows are each judged.
    """
    text = F.col(text) if isinstance(text, str) else text
    blank = F.lit(None).cast("string")
    fields = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    extra = [F.coalesce(e, blank).alias(n) if e is not None else blank.alias(n) for e, n in ((evidence.host, "_host"), (evidence.declared, "_declared"), (evidence.suffix, "_suffix"))]
    rows = likelihoods(df, model, text, [*fields, *extra])
    rows = rows.withColumn("_domain", F.when(F.col("_host").contains("."), F.array_join(F.slice(F.split("_host", r"\."), -2, 2), ".")).otherwise(F.col("_host")))
    best = F.when(F.col("_n") > 0, F.array_position(F.col("_ll"), F.array_max("_ll")).cast("int") - 1)
    rows = settle(rows.withColumn("_best", best))
    names = F.array(*map(F.lit, model.languages)) if model.languages else F.array().cast("array<string>")
    width = len(model.languages)
    if not width:
        return rows.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), blank.alias("lang"), F.lit(0.0).alias("confidence"), blank.alias("text_lang"), F.lit(False).alias("accepted"))
    sure = rows.where("_best is not null")
    tally = F.array(*(F.count(F.when(F.col("_best") == k, 1)).cast("double") for k in range(width)))
    total = sure.agg(tally.alias("c")).first()["c"]
    everywhere = [(c + 1) / (sum(total) + width) for c in total]
    base = F.array(*map(F.lit, everywhere))
    add = lambda a, b, by: F.zip_with(a, b, lambda x, y: x + y * by)
    none = F.array_repeat(F.lit(0.0), width)
    hosts = sure.where("_host is not null").groupBy("_host").agg(tally.alias("_hc"))
    domains = sure.where("_domain is not null").groupBy("_domain").agg(tally.alias("_dc"))
    told = {n: sure.where(f"{n} is not null").groupBy(n).agg(tally.alias(f"{n}_c")) for n in ("_declared", "_suffix")}
    share = F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("_share")
    rows = rows.withColumn("_share", F.pmod(F.xxhash64("_ll", *(f"_k{i}" for i in range(len(keep)))), F.lit(SHARES)).cast("int"))
    joined = rows.join(hosts.select("*", share), ["_host", "_share"], "left").join(domains.select("*", share), ["_domain", "_share"], "left")
    for n, t in told.items():
        joined = joined.join(t.select("*", share), [n, "_share"], "left")
    own = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.when(F.col("_best") == k, 1.0).otherwise(0.0))
    less = lambda c: F.transform(add(F.coalesce(F.col(c), none), F.col("_own"), -1.0), lambda v: F.greatest(v, F.lit(0.0)))
    sum_ = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    log = lambda a: F.transform(a, lambda p: F.log(p))
    fused = joined.withColumn("_own", own)

    def smoothed(df: DataFrame, counts: str, above: Column, name: str) -> DataFrame:
        """Shares of counts, drawn to those above; each step is a column, so nothing is computed again for each element."""
        df = df.withColumn(name, less(counts)).withColumn(f"{name}_n", sum_(F.col(name)) + SMOOTHING)
        return df.withColumn(name, F.zip_with(name, above, lambda v, p: (v + SMOOTHING * p) / F.col(f"{name}_n")))

    fused = smoothed(fused, "_dc", base, "_ds")
    fused = smoothed(fused, "_hc", F.col("_ds"), "_hs")
    fused = fused.withColumn("_score", add(F.col("_ll"), log(F.col("_hs")), 1.0))
    for c in ("_declared_c", "_suffix_c"):
        # P(declaration | language) up to a factor: its share among the rows of the language, smoothed to say nothing
        fused = smoothed(fused, c, base, f"{c}s")
        said = F.when(F.col(c).isNotNull(), F.zip_with(f"{c}s", base, lambda p, q: F.log(p / q))).otherwise(none)
        fused = fused.withColumn("_score", add(F.col("_score"), said, 1.0))
    fused = fused.withColumn("_top", F.array_max("_score")).withColumn("_e", F.transform("_score", lambda v: F.exp(v - F.col("_top"))))
    fused = fused.withColumn("_all", sum_(F.col("_e"))).withColumn("_p", F.transform("_e", lambda v: v / F.col("_all")))
    at = F.array_position("_p", F.array_max("_p")).cast("int")
    has = F.col("_best").isNotNull()
    # none of the languages: each hash of a trigram is as likely as any other
    none_of_them = -math.log(TABLE) * F.least(F.col("_n").cast("double"), WEIGHT * F.sqrt("_n"))
    return fused.select(
        *(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), F.when(has, F.element_at(names, at)).alias("lang"),
        F.when(has, F.array_max("_p")).otherwise(0.0).alias("confidence"), F.when(has, F.element_at(names, F.col("_best") + 1)).alias("text_lang"),
        (has & (F.array_max("_p") >= least) & (F.element_at("_ll", at) > none_of_them)).alias("accepted"),
    )


def declared_in(markup: Column) -> Column:
    """Two-letter language of the first ``lang`` attribute of an html tag, or null."""
    found = F.lower(F.regexp_extract(markup, r"(?i)<html[^>]*?\blang\s*=\s*[\"']?([a-z]{2})", 1))
    return F.when(F.contains(F.lower(markup), F.lit("<html")), F.nullif(found, F.lit("")))


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1)), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The address's last label if it is two letters (a country's)."""
    return F.nullif(F.regexp_extract(host, r"\.([a-z]{2})$", 1), F.lit(""))


def plain(html: Column) -> Column:
    """Text of a page: scripts, styles and tags are spaces."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")


def identify_documents(df: DataFrame, keep: list[str], least: float = 0.4, text: str = "text", source: str = "source", label: str = "lang", key: str = "doc_id") -> DataFrame:
    """For tables like ``documents``: the text, markup in it, and the source as host, with its suffix where it is an address.

    Trained on a bounded sample of the table's own labels; rows are judged by the text and not by their label.
    """
    host = F.col(source).cast("string")
    return identify(df, train(df, text, label, key), Evidence(host, declared_in(F.col(text)), suffix_of(host)), keep, text, least)


def identify_pages(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """For tables like ``pages``: text without tags, declared language, address suffix and host; trained on labelled documents."""
    host = host_of(F.col("url"))
    return identify(pages, train(documents), Evidence(host, declared_in(F.col("html")), suffix_of(host)), ["page_id"], plain(F.col("html")))


def keep_identified(df: DataFrame, least: float = 0.4, doc_id: str = "doc_id") -> DataFrame:
    """Rows of ``df`` (with text, source and lang) whose language is identified, with all their columns, whatever their names.

    Rows are judged each by its own text, those that repeat a doc_id or have none too; equal rows stay or go together.
    """
    name = F.xxhash64(doc_id, "text", "source")
    judged = df.select(F.col(doc_id).alias("id"), name.alias("name"), "text", "source", "lang")
    kept = identify_documents(judged, ["id", "name"], least, key="name").where("accepted").select("id", "name").distinct()
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(doc_id).alias("of"), name.alias("by"))
    found = rows.join(kept, F.col("of").eqNullSafe(F.col("id")) & (F.col("by") == F.col("name")), "left_semi")
    return found.select(*(F.col(f"row.`{c}`").alias(c) for c in df.columns))
