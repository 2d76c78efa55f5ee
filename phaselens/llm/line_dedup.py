"""Near-duplicate lines by an exact set-similarity join, in DataFrame operations only.

A line's tokens are its distinct words.  They are ordered by rarity - by the numbers of words in the ranges of a table of
counts over all lines, then by hash - and only the first few, the prefix, can start a match.  Prefix, length and
positional filters, and a signature of 128 bits that tells how much two sets differ at least, leave candidate pairs,
whose Jaccard similarity is then computed.  A line goes if an earlier one, by document and line number, is similar enough.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phaselens.llm.runtime import concluded, release, settle, sieve

PERCENT = 80
#: Bits of the number of ranges of the table of counts: it follows the number of lines between two bounds.
LEAST_BITS, MOST_BITS = 16, 20
#: Lines of a token that are first compared with the earliest of them only; those that match it need no others.
HOT = 256
#: Lines of a longer list that meet as many others at once.
BLOCK = 4096
#: Bytes of text whose prefixes share a partition of their join: its table of entries, at most one for each ten bytes, fits in a task's memory.
SHARE = 10_000_000
#: Bytes of text that count as a line where the table of counts gets its size.
LINE = 256
#: How much wider classes of sizes are than the ratio of sizes that may match, so that rounding can't set such sizes two classes apart.
WIDTH = 1.001
#: The setting by which tables dealt by one of the columns that they are joined on aren't dealt anew by all of them.
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


def words_of(line: Column) -> Column:
    """A line's words, some of them empty: they stand between spaces and the control characters from tab to carriage return, in lower case."""
    odd = F.lit(False)
    for c in "\t\x0b\x0c\r":
        odd = odd | F.contains(line, F.lit(c))
    return F.split(F.lower(F.when(odd, F.translate(line, "\t\x0b\x0c\r", "    ")).otherwise(line)), " ")


def split_lines(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, no (from 0), line of each line that has words; rows with a null doc_id or text have none.

    Told from the line, not from its words: Spark would compute the hashes of the words in a filter on them, and once more behind it.
    """
    rows = df.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_t"))
    return rows.select("doc_id", F.posexplode(F.split("_t", "\n")).alias("no", "line")).where(F.ltrim("line", F.lit(" \t\x0b\x0c\r")) != "")


def line_count(text: Column) -> Column:
    """The number of a text's lines, null for a null text; its line feeds are counted without splitting it."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def hashed(lines: DataFrame, *others: str) -> DataFrame:
    """``others`` and h: sorted distinct 64-bit hashes of a line's words."""
    each = F.transform(words_of(F.col("line")), lambda w: F.xxhash64(w))
    return lines.select(*others, F.sort_array(F.array_remove(F.array_distinct(each), F.xxhash64(F.lit("")))).alias("h"))


def tokenised(lines: DataFrame) -> DataFrame:
    """doc_id, no, n, x, y, t: the number of a line's distinct words, hashes of their set, and its tokens, 32 bits of each.

    Tokens of 32 bits may agree by chance, which makes candidates only; sizes, equality and similarity go by 64 bits and more.
    """
    # of sorted longs the leading 32 bits are sorted, too
    tokens = F.transform("h", lambda h: F.shiftright(h, 32).cast("int"))
    return hashed(lines, "doc_id", "no").select("doc_id", "no", F.size("h").alias("n"), F.xxhash64("h").alias("x"), F.hash("h").alias("y"), tokens.alias("t"))


def rarity(lines: DataFrame, bits: int) -> Column:
    """``level_of`` the number of lines with a token of each of 2 ** bits ranges, as an array of bytes.

    The counts are of all lines; what reaches the driver has the size of the table, whatever the input.  A task sends as many counts
    as the table has ranges, so there are two tasks for each core and not one for each file.
    """
    tasks = 2 * lines.sparkSession.sparkContext.defaultParallelism
    counts = lines.coalesce(tasks).select(F.explode("t").alias("t")).groupBy(F.col("t").bitwiseAND((1 << bits) - 1).alias("k")).agg(F.count("*").alias("n"))
    level = F.least(F.floor(3 * F.log2(F.col("n") + 1)), F.lit(127)).cast("int")
    found = settle(counts.select("k", level.alias("level"))).toArrow()
    table = np.zeros(1 << bits, int)
    table[found.column("k").to_numpy()] = found.column("level").to_numpy()
    return F.split(F.lit(",".join(map(str, table.tolist()))), ",").cast("array<tinyint>")


def level_of(number: int) -> int:
    """3 levels for each doubling of a number."""
    return min(127, math.floor(3 * math.log2(1 + number)))


def least(n: Column, percent: int) -> Column:
    return F.ceil(n * percent / 100)


def enough(n: Column, m: Column, percent: int) -> Column:
    """Tokens that sets of these sizes share at least if they are similar enough."""
    return F.ceil((n + m) * percent / (100 + percent))


def signed(lines: DataFrame, table: Column, bits: int, percent: int) -> DataFrame:
    """``lines`` with s, u, prefix in place of t: a set's signature, and its first tokens by level in the table and then by hash.

    A prefix's tokens are longs: their level times 2 ** 32, plus their own signed bits.  The signature s has, for each value of the last 6 bits, whether
    the number of tokens with this value is odd; u has the same for tokens with the sign bit alone.
    Two sets differ in as many tokens as signatures in bits, or more.
    """
    level = lambda t: F.get(table, t.bitwiseAND((1 << bits) - 1)).cast("long")
    # told to be never null, an array is sorted as one of numbers and not of objects
    keys = F.sort_array(F.transform("t", lambda t: F.coalesce(F.call_function("shiftleft", level(t), F.lit(32)) + t.cast("long"), F.lit(0).cast("long"))))
    # a shift of a long goes by the last 6 bits of the distance
    odd = lambda value: F.aggregate("t", F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(F.call_function("shiftleft", value(t), t)))
    kept = [c for c in lines.columns if c != "t"]
    s = odd(lambda t: F.lit(1).cast("long"))
    u = odd(lambda t: F.shiftrightunsigned(t, 31).cast("long"))
    return lines.select(*kept, s.alias("s"), u.alias("u"), F.slice(keys, F.lit(1), (F.col("n") - least(F.col("n"), percent) + 1).cast("int")).alias("prefix"))


def apart_at_least(s: Column, t: Column, u: Column, v: Column) -> Column:
    """In how many tokens two sets differ at least, by their signatures (s, u) and (t, v)."""
    every, signs = s.bitwiseXOR(t), u.bitwiseXOR(v)
    return F.bit_count(every.bitwiseXOR(signs)) + F.bit_count(signs)


def later_matches(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, no of each line that an earlier one matches: |A and B| * 100 >= percent * |A or B| for their sets of words.

    Earlier means a smaller doc_id, or the same and a smaller line number (from 0).  Lines without words never match; rows with a
    null doc_id or text have no lines.  Where rows repeat a doc_id, a place is one line, which is any of those that stand there.
    """
    key = F.col(doc_id).cast("long")
    ends = df.agg(F.min(key).alias("a"), F.max(key).alias("b"), F.max(F.octet_length(text)).alias("n"), F.sum(F.octet_length(text)).alias("size")).first()
    size = int(ends["size"] or 0)
    lines, shares = size // LINE, 1 + size // SHARE
    span = 0 if ends["a"] is None else (ends["b"] - ends["a"]).bit_length()
    # a text has as many lines as bytes at most; they are counted only where that leaves too few bits
    bits = int((ends["n"] or 0) + 1).bit_length()
    if span + bits >= 63:
        bits = int(df.agg(F.max(line_count(F.col(text)))).first()[0] or 1).bit_length()
    if span + bits < 63:
        return _matches(df, doc_id, text, percent, ends["a"] or 0, bits, lines, shares)
    # ids too far apart to be packed into a long with a line's number: go by their ranks, which keep the order
    ranks = settle(df.select(key.alias("of")).where("of is not null").distinct().orderBy("of").withColumn("_m", F.monotonically_increasing_id()))
    sizes = {r["p"]: r["n"] for r in ranks.groupBy(F.shiftright("_m", 33).alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, total = {}, 0
    for p in sorted(sizes):
        starts[p], total = total, total + sizes[p]
    if total.bit_length() + bits > 62:
        raise ValueError("more lines than a long can number")
    start = F.element_at(F.create_map(*(F.lit(v).cast("long") for kv in starts.items() for v in kv)), F.shiftright("_m", 33))
    ranks = ranks.select("of", (start + F.col("_m").bitwiseAND((1 << 33) - 1)).alias("_rank"))
    by_rank = df.select(key.alias("of"), F.col(text).alias("_text")).join(ranks, "of").select("_rank", "_text")
    found = _matches(by_rank, "_rank", "_text", percent, 0, bits, lines, shares)
    return found.join(ranks, found["doc_id"] == ranks["_rank"]).select(F.col("of").alias("doc_id"), "no")


def _matches(df: DataFrame, doc_id: str, text: str, percent: int, low: int, bits: int, lines: int, shares: int) -> DataFrame:
    """``later_matches`` for ids from ``low`` on that can be packed into a long with ``bits`` of a line's number."""
    number = F.call_function("shiftleft", F.col("doc_id") - F.lit(low).cast("long"), F.lit(bits)) + F.col("no")
    doc_of = lambda i: F.shiftright(i, bits) + F.lit(low).cast("long")
    every = split_lines(df, doc_id, text)
    ranges = min(MOST_BITS, max(LEAST_BITS, lines.bit_length() - 4))
    seen = settle(tokenised(every).withColumn("id", number).drop("doc_id", "no"))
    # sets that several lines have: all of those but the earliest go, whatever that one does
    several = settle(seen.groupBy("x", "y", "n").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies"))
    may_repeat = sieve(several.select("x"), F.col("x"))
    told = settle(seen.where(may_repeat).select("id", "x", "y", "n").join(several, ["x", "y", "n"], "left").select("id", (F.col("id") != F.coalesce("first", "id")).alias("copy")))
    copies, stay = (told.where(x).select("id") for x in ("copy", "not copy"))
    # the tokens of copies are neither shuffled nor written again
    kept = seen.where(may_repeat & sieve(stay, F.col("id"))).join(stay, "id", "left_semi")
    once = seen.where(~may_repeat).select("id", "n", "t").unionAll(kept.select("id", "n", "t"))
    # a set too small to lose a token matches no other set
    sets = settle(signed(once.where(F.col("n") * 100 >= (F.col("n") + 1) * percent), rarity(seen, ranges), ranges, percent))
    release(seen)
    # a token whose range has one line is in no other
    posted = sets.select("id", "n", "s", "u", F.posexplode("prefix").alias("pos", "token")).withColumn("token", F.col("token") + F.lit(1 << 31))
    level = F.shiftright("token", 32)
    posted = posted.where(level > level_of(1))

    def matched(chosen: DataFrame, few: bool = False) -> DataFrame:
        """b of the pairs (a, b) of places that are similar enough; the sets are made again from the texts, of which ``few`` may be needed."""
        wanted = settle(chosen.select(F.col("a").alias("id")).unionAll(chosen.select("b")).distinct())
        texts = df.where(sieve(wanted.select(doc_of(F.col("id")).alias("id")).distinct(), F.col(doc_id).cast("long"))) if few else df
        some = split_lines(texts, doc_id, text).withColumn("id", number)
        whole = settle(hashed(some.where(sieve(wanted, F.col("id"))), "id"))
        a, b = (whole.select(F.col("id").alias(k), F.col("h").alias(f"h{k}")) for k in "ab")
        shared = F.size(F.array_intersect("ha", "hb"))
        return chosen.join(a, "a").join(b, "b").where(shared >= enough(F.size("ha"), F.size("hb"), percent)).select("b").distinct()

    def likely(n: Column, m: Column, s: Column, t: Column, u: Column, v: Column) -> Column:
        """The length filter, and sizes and signatures that leave enough in common."""
        return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (n + m - apart_at_least(s, t, u, v) >= 2 * enough(n, m, percent))

    c = F.col
    # long lists, which only tokens of a well-filled range can have: their lines first meet the earliest one
    lists = posted.where(level >= level_of(HOT)).groupBy("token").agg(F.count("*").alias("size"), F.min("id").alias("first"), *(F.min_by(k, "id").alias(f"f{k}") for k in "nsu"))
    lists = settle(lists.where(c("size") > HOT))
    early = None
    both = lambda at: (F.call_function("shiftleft", c("n").cast("long"), F.lit(32)) + at).alias("both")
    entries = posted.select("token", "id", "s", "u", both(c("pos") * 8))
    if not lists.isEmpty():
        may = (level >= level_of(HOT)) & sieve(lists.select("token"), c("token"))
        hot = settle(posted.where(may).join(lists, "token", "left"))
        first = hot.where((c("id") != c("first")) & likely(c("n"), c("fn"), c("s"), c("fs"), c("u"), c("fu")))
        near = settle(first.select("token", c("first").alias("a"), c("id").alias("b")))
        # a list with few lines that may match its earliest one is not shortened much by looking at their texts
        crowded = settle(near.groupBy("token").agg(F.count("*").alias("size")).where(c("size") > HOT).select("token"))
        done = hot.withColumn("done", F.lit(0))
        if not crowded.isEmpty():
            early = settle(matched(settle(near.join(crowded, "token", "left_semi").select("a", "b").distinct()), few=True))
            done = hot.join(early.select(c("b").alias("id"), F.lit(1).alias("done")), "id", "left").withColumn("done", F.coalesce("done", F.lit(0)))
        # blocks of a long list meet each other: side tells the two of a meeting apart, 0 is a block by itself
        blocks = F.ceil(F.coalesce("size", F.lit(1)) / BLOCK).cast("int")
        dealt = done.withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        i, j = F.least("own", "other"), F.greatest("own", "other")
        side = F.when(i == j, 0).when(c("own") == i, 1).otherwise(2)
        name = F.when(blocks == 1, c("token")).otherwise(F.xxhash64("token", i, j))
        entries = entries.where(~may).unionAll(dealt.select(name.alias("token"), "id", "s", "u", both(c("pos") * 8 + side * 2 + c("done"))))
    # both sides are one and the same exchange; behind it sets meet those of their own class of sizes and, as the larger ones, those of the next lower.
    # 32 bits of a token are all that a line's token has, and with a class they make one long, by which the table of a partition's entries is hashed
    entries = entries.withColumn("token", c("token").bitwiseAND((1 << 32) - 1).bitwiseXOR(1 << 31) - F.lit(1 << 31)).withColumn("token", c("token").cast("int")).repartition(shares, "token")
    entries = entries.select("token", "id", "s", "u", F.shiftright("both", 32).cast("int").alias("n"), c("both").bitwiseAND((1 << 32) - 1).cast("int").alias("at"))
    size = lambda n: F.coalesce(F.floor(F.ln(n) / math.log(WIDTH * 100 / percent)).cast("int"), F.lit(0))
    place = F.shiftright("at", 3)
    # the first token that two sets share has what they share behind it in both.  Of two sets the smaller one thus needs it among fewer, and a
    # late token of the larger one meets much smaller sets only.  Told by classes that are null, so that both sides stay one and the same exchange
    early_enough = (c("n") - place) * (100 + percent) >= c("n").cast("long") * (2 * percent)
    largest = F.floor((c("n") - place) * (100 + percent) / percent) - c("n") + 1
    smaller = entries.withColumn("class", F.explode(F.array(F.when(early_enough, size(c("n"))))))
    larger = entries.withColumn("class", F.explode(F.array(size(c("n")) - 1, F.when(size(largest) >= size(c("n")), size(c("n"))))))
    l, r = (x.select("token", "class", *(c(k).alias(f"{k}{z}") for k in ("id", "s", "u", "at")), c("n").cast("long").alias(f"n{z}")) for x, z in ((smaller, "l"), (larger, "r")))
    pl, pr = (F.shiftright(f"at{z}", 3) for z in "lr")
    whole = c("nl") + c("nr")
    # whole numbers throughout, and the cheapest and strictest first, as most pairs that share a token fail at their sizes
    lengths = (c("nl") <= c("nr")) & (c("nr") * percent <= c("nl") * 100) & ((c("nl") < c("nr")) | (c("idl") < c("idr"))) & (c("idl") != c("idr"))
    positional = F.least(c("nl") - pl, c("nr") - pr) * (100 + percent) >= whole * percent
    apart = apart_at_least(c("sl"), c("sr"), c("ul"), c("ur"))
    signatures = (whole - apart) * (100 + percent) >= whole * (2 * percent)
    sides = c("atl").bitwiseAND(6)
    later_is_open = F.when(c("idl") < c("idr"), c("atr")).otherwise(c("atl")).bitwiseAND(1) == 0
    met = (sides == 0) | (sides != c("atr").bitwiseAND(6))
    pairs = l.hint("shuffle_hash").join(r, ["token", "class"]).where(lengths & positional & signatures & met & later_is_open)
    pairs = settle(pairs.select(F.least("idl", "idr").alias("a"), F.greatest("idl", "idr").alias("b"), apart.alias("apart")), also={CO_PARTITION: "false"})
    # each line first with the earlier one that seems the most alike; only lines without a match then with all of theirs
    first = settle(pairs.groupBy("b").agg(F.min_by("a", "apart").alias("a")))
    gone = settle(matched(first))
    still = settle(first.select("b").join(gone, "b", "left_anti"))
    others = settle(pairs.where(sieve(still, c("b"))).select("a", "b").join(still, "b", "left_semi").distinct())
    gone = gone.unionAll(matched(others, few=True))
    gone = (gone if early is None else gone.unionAll(early)).select(c("b").alias("id"))
    out = copies.unionAll(gone).distinct()
    return out.select(doc_of(c("id")).alias("doc_id"), c("id").bitwiseAND((1 << bits) - 1).cast("int").alias("no"))


def drop_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """All rows and columns of ``df``, with matched lines taken out of ``text``, and n_lines, n_removed (long).

    A null text stays null with no lines; a text all of whose lines go is empty.  Lines without words stay, and so do rows with
    a null doc_id.  Columns of ``df`` named n_lines or n_removed are replaced; others may have any names.
    """
    gone = concluded(lambda: later_matches(df, doc_id, text, percent).groupBy(F.col("doc_id").alias("of")).agg(F.sort_array(F.collect_list("no")).alias("gone")))
    others = [x for x in df.columns if x not in ("n_lines", "n_removed")]
    rows = df.select(F.struct(*others).alias("row"), F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    lines = F.split("text", "\n")
    rows = rows.withColumn("number", F.coalesce(line_count(F.col("text")), F.lit(0)).cast("long"))
    told = lambda removed, out: [*((out if x == text else F.col(f"row.`{x}`")).alias(x) for x in others), F.col("number").alias("n_lines"), removed.cast("long").alias("n_removed")]
    stays = F.filter(F.zip_with(lines, F.sequence(F.lit(0), F.size(lines) - 1), lambda l, i: F.struct(l.alias("l"), i.alias("i"))), lambda z: ~F.array_contains(F.col("gone"), z["i"]))
    # only texts that may lose lines are shuffled
    hit = F.coalesce(sieve(gone.select("of"), F.col("id")), F.lit(False))
    cut = rows.where(hit).join(gone, F.col("id") == F.col("of"), "left")
    loses = F.col("gone").isNotNull() & F.col("text").isNotNull()
    out = F.when(loses, F.array_join(F.transform(stays, lambda z: z["l"]), "\n")).otherwise(F.col("text"))
    removed = F.when(loses, F.size(F.filter("gone", lambda i: i < F.col("number")))).otherwise(F.lit(0))
    return rows.where(~hit).select(*told(F.lit(0), F.col("text"))).unionByName(cut.select(*told(removed, out)))
