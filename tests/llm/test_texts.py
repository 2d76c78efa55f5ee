import hashlib
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phaselens.llm import language_id, license_scan, line_dedup, packing, pii, piece_codec, runtime
from phaselens.llm.queries import vocabulary

PIECES, WORDS = vocabulary("piece_bpe_32k.model"), vocabulary("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, no int, n long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], SCHEMA)


# Subword codec

TEXTS = st.text(st.one_of(st.sampled_from("abcdehinorst  \n\t.,'▁éß中😀\u0301\x00()!-012"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_codec_is_the_library(text):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES) if not hasattr(test_codec_is_the_library, "own") else test_codec_is_the_library.own
    test_codec_is_the_library.own = library
    own = piece_codec.codec(PIECES)
    ids = library.encode(text)
    assert own.encode(text) == ids
    assert own.decode(ids) == library.decode(ids)
    assert own.digest(text.encode()) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_codec_round_trip_in_columns(spark):
    texts = ["Hello  world\n", None, "", "x" * 50_000, "naïve 中文", " lead"]
    coded = piece_codec.decode_ids(piece_codec.encode_texts(frame(spark, texts), PIECES), PIECES)
    rows = {r["doc_id"]: r for r in coded.collect()}
    assert [rows[i]["decoded"] for i in range(len(texts))] == [t or "" for t in texts]
    assert rows[1]["ids"] == [] and coded.columns[:4] == ["doc_id", "text", "no", "n"]
    assert piece_codec.token_digests(frame(spark, []), PIECES).count() == 0
    long = frame(spark, ["ab cde " * 300_000, "ab", None])
    twice = piece_codec.token_digests(long.unionAll(long), PIECES).collect()
    library = test_codec_is_the_library.own.encode("ab cde " * 300_000)
    want = {0: (len(library), hashlib.sha256(",".join(map(str, library)).encode()).hexdigest()), 1: None, 2: (0, hashlib.sha256(b"").hexdigest())}
    assert sorted(r["doc_id"] for r in twice) == [0, 0, 1, 1, 2, 2]
    assert all(want[r["doc_id"]] in (None, (r["n_tokens"], r["ids_sha256"])) for r in twice)


# Packing


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abcdehinorstTHE  \n\t.,''''çéßÉÀñ012()!-*ſŒ<|>"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_word_ids_are_the_library(text):
    import numpy as np

    own = packing._tokens.get(WORDS) or packing._tokens.setdefault(WORDS, packing.WordTokens(WORDS))
    assert own.ids([text.encode()])[0] == np.array(own.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def least_by_force(sizes, capacity):
    best = len(sizes)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= sizes[k] and rooms[i] not in rooms[:i]:
                place(k + 1, [*rooms[:i], rooms[i] - sizes[k], *rooms[i + 1 :]])
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=11))
def test_few_items_are_packed_best(sizes):
    plan = packing.bin_completion({s: sizes.count(s) for s in sizes}, 20)
    used = [s for p, n in plan for s, k in p for _ in range(k * n)]
    assert sorted(used) == sorted(sizes) and all(sum(s * k for s, k in p) <= 20 for p, _ in plan)
    assert sum(n for _, n in plan) == least_by_force(sorted(sizes, reverse=True), 20)
    assert packing.least_bins({s: sizes.count(s) for s in sizes}, 20) <= sum(n for _, n in plan) or not sizes


def test_planted_sequences_are_found():
    planted = [[983, 942, 901, 819, 819, 778, 738, 738, 737, 737]]
    for seed in range(12):
        r, sizes = random.Random(seed), []
        for _ in range(r.randint(2, 20)):
            cuts = sorted(r.sample(range(200, 3896), r.randint(3, 5)))
            sizes += [b - a for a, b in zip([0, *cuts], [*cuts, 4096], strict=True)]
        planted.append(sizes)
    for sizes in planted:
        plan = packing.bin_completion({s: sizes.count(s) for s in sizes}, 4096)
        assert sum(n for _, n in plan) * 4096 == sum(sizes)
        assert sorted(s for pattern, n in plan for s, k in pattern for _ in range(n * k)) == sorted(sizes)
        assert all(sum(s * k for s, k in pattern) == 4096 for pattern, _ in plan)


def test_bins_that_fill_exactly_are_found():
    missed = 0
    for seed in range(400):
        r, sizes = random.Random(seed), []
        while len(sizes) < 9:
            cuts = sorted(r.sample(range(1, 100), r.randint(2, 5)))
            sizes += [b - a for a, b in zip([0, *cuts], [*cuts, 100], strict=True)]
        plan = packing.bin_completion({s: sizes.count(s) for s in sizes}, 100)
        missed += sum(n for _, n in plan) * 100 != sum(sizes)
    assert missed == 0
    hard = [2, 5, 5, 5, 8, 9, 12, 13, 16, 17, 18, 18, 21, 24, 34, 35, 35, 36, 36, 51]
    assert sum(n for _, n in packing.bin_completion({s: hard.count(s) for s in hard}, 100)) == 4


def test_packed_places(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice(["a", "bb", "THE", "été"]) for _ in range(r.choice([0, 3, 50, 100, 900]))) for _ in range(120)] + [None, "", "x y " * 3000] + ["same text"] * 40
    df = frame(spark, texts).unionAll(frame(spark, texts[:5]))
    out = packing.pack_documents(df, WORDS, capacity=256, with_ids=True).collect()
    bins = {}
    for row in out:
        assert row["length"] == len(row["ids"]) // 4 and row["start"] == 256 * row["piece"]
        bins.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(r["length"] for r in out) == sum(len(packing.WordTokens(WORDS).ids([(t or "").encode()])[0]) // 4 + 1 for t in texts + texts[:5])
    assert packing.pack_documents(frame(spark, []), WORDS).count() == 0
    pieces = packing.pieces(df, WORDS, 256).select("*", *(F.lit(5).alias(c) for c in ("_share", "_n", "_before", "_rank", "offset")))
    again = packing.pack(pieces, 256)
    assert again.columns == [*pieces.columns[:-1], "sequence_id", "offset", "proven"]
    assert sorted((r["doc_id"], r["piece"], r["sequence_id"], r["offset"]) for r in again.collect()) == sorted((r["doc_id"], r["piece"], r["sequence_id"], r["offset"]) for r in out)


def test_the_search_goes_on_until_all_is_searched_without_a_bound(spark):
    lengths = {34: 4, 33: 2, 51: 3, 26: 3, 23: 3}
    plan, proven = packing.search(lengths, 100, nodes=None)
    assert proven and sum(n for _, n in plan) <= sum(n for _, n in packing.search(lengths, 100, nodes=1)[0])
    cut = spark.createDataFrame([(k, 0, s) for k, s in enumerate(s for s, n in lengths.items() for _ in range(n))], "doc_id long, piece int, length long")
    found = packing.pack(cut, 100, nodes=None).collect()
    assert all(r["proven"] for r in found) and len({r["sequence_id"] for r in found}) == sum(n for _, n in plan)


def test_even_dives_come_near_the_bound():
    for seed, number, low, high, most in ((1, 5000, 700, 1250, 1200), (2, 2000, 700, 1250, 478)):
        r = random.Random(seed)
        lengths = Counter(r.randint(low, high) for _ in range(number))
        plan, _ = packing.search(lengths, 4096, nodes=401)
        used = Counter()
        for pattern, n in plan:
            assert sum(s * k for s, k in pattern) <= 4096
            used.update({s: n * k for s, k in pattern})
        bins = sum(n for _, n in plan)
        assert used == lengths and bins <= most < sum(n for _, n in packing.best_fit(lengths, 4096)) - 30


def test_equal_keys_give_the_same_model_however_rows_are_dealt(spark):
    rows = [(1, f"word{k} the and of {k}", "en") for k in range(40)] + [(1, f"mot{k} le et la {k}", "fr") for k in range(40)]
    tables = [language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(n), rows=15).logp for n in (1, 7)]
    assert (tables[0] == tables[1]).all()


def test_what_is_proven():
    assert packing.search({60: 2, 40: 2}, 100) == (packing.bin_completion({60: 2, 40: 2}, 100), True)
    assert packing.search({34: 4, 33: 2}, 100)[1] and not packing.search({k: 3 for k in range(700, 1250, 7)}, 4096, nodes=1)[1]
    assert packing.search({}, 10) == ([], True)


# Licences


def test_exact_and_fuzzy_notices(spark):
    texts = [
        "All rights reserved. The General Public License, CC-BY.", "all rihgts reserved here", "All right reserved", "overall rights reserved", "cc by cc by", None, "", "ll rights", "x " * 50_000 + "ALL RIGHTS RESERVED",
        "Licensed under the Apache Licence, Version 2.0", "nothing of the kind",
    ]
    rows = {r["doc_id"]: r for r in license_scan.license_labels(frame(spark, texts)).collect()}
    assert (rows[0]["n_base"], rows[0]["first_word"], rows[0]["last_word"], rows[0]["base_labels"], rows[0]["score"]) == (3, 0, 7, "cc-by,gpl,reserved", 1.0)
    assert rows[1]["labels"] == "reserved" and rows[1]["n_base"] == 0 and 0 < rows[1]["score"] < 1
    assert rows[2]["labels"] == "reserved"
    assert rows[3]["n_base"] == 0
    assert rows[4]["n_base"] == 2 and rows[4]["last_word"] == 2
    assert rows[5]["n_words"] == 0 == rows[6]["n_words"] and rows[5]["score"] == 0.0 and rows[5]["first_word"] is None
    assert rows[8]["first_word"] == 50_000
    assert rows[9]["labels"] == "apache-2.0" and rows[10]["labels"] == ""
    assert license_scan.license_labels(frame(spark, [])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["all", "rights", "reserved", "cc", "by", "x", "general", "public", "license"]), max_size=20))
def test_base_places(words):
    n, found = license_scan.Scanner(license_scan.BASE).scan(" ".join(words).encode())
    exact = sorted((s[1], s[2]) for s in found if s[4] == 0)
    want = sorted((p.words, i) for p in license_scan.BASE for i in range(len(words)) if words[i : i + len(p.words.split())] == p.words.split())
    assert n == len(words) and exact == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("under the genral public license or the general public license v2", {(2, 1), (7, 0)}),
        ("genral public licnse a genaral public license b", {(0, 2), (4, 1)}),
        ("genral public licnse or general public licens or genral public licnse", {(0, 2), (4, 1), (8, 2)}),
        ("public license general public licence general license public", {(2, 1)}),
    ],
)
def test_worse_notices_beside_better_ones(text, want):
    found = license_scan.Scanner([license_scan.BASE[1]]).scan(text.encode())[1]
    assert {(first, errors) for _, _, first, _, errors in found} == want and len(found) == len(want)


def test_many_notices_take_time_in_proportion():
    import time

    scanner, took = license_scan.Scanner(license_scan.BASE + license_scan.OWN), []
    for n in (5_000, 20_000):
        text = b"all rights reserved all rihgts reserved general public licens x " * n
        began = time.perf_counter()
        words, found = scanner.scan(text)
        took.append(time.perf_counter() - began)
        assert words == 10 * n and len(found) == 3 * n
        assert sorted(s[2] for s in found)[-3:] == [10 * n - 10, 10 * n - 7, 10 * n - 4]
    assert took[1] < 8 * took[0]


def errors_between(a, b):
    """Fewest characters added, lost or changed."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 10_000)), min_size=1, max_size=4))
def test_altered_notices_against_edit_distances(changes):
    notice = license_scan.Notice("all rights reserved", "reserved", 2, True)
    parts, filler = [], "zzzz qqqq zzzz qqqq"
    for number, seed in changes:
        r, chars = random.Random(seed), list(notice.words)
        for _ in range(number):
            at = r.randrange(len(chars))
            chars[at : at + r.randint(0, 1)] = r.choice(["", "x", "k", "r", "kx"])[:1]
        parts += [filler, " ".join("".join(chars).split())]
    words = " ".join([*parts, filler]).split()
    best = {}
    for i in range(len(words)):
        for j in range(i + 1, min(len(words), i + 6) + 1):
            e = errors_between(notice.words, " ".join(words[i:j]))
            if e <= notice.errors:
                best[i] = min(e, best.get(i, e))
    found = license_scan.Scanner([notice]).scan(" ".join(words).encode())[1]
    own = {first: errors for _, _, first, _, errors in found}
    # each place that fits is found, or a better one that it overlaps; the errors that are told are the fewest
    assert all(best[i] == e for i, e in own.items())
    for i, e in best.items():
        assert i in own or any(abs(i - k) <= 5 and own[k] <= e for k in own), (words, i)


# Personal data


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans(spark):
    r = random.Random(7)
    parts = ["a@b.c", "@", ".", "..", "x.y@z-1.co.uk", "1.2.3.4", "256.1.1.1", "0001.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+", "1", " ", "-", "  ", "é😀", "\x01", "_", "a.b", "99999999999999999999.1.1.1", "+12", "(", "a@b.c@d.e", "a@b.c_x@d.e", "\n"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(1500)]
    texts += [None, "", "a" * 200_000, "1" * 200_000, "1 " * 100_000, "a@" * 50_000, "a@b" + ".c" * 50_000, "1." * 100_000, "+1" + "(" * 100_000]
    found = pii.find_spans(frame(spark, texts)).collect()
    assert len(found) == len(texts)
    for row in found:
        if (row["text"] or "")[:3] in ("1 1",) and len(row["text"]) > 1000:
            assert row["base"] == []
            continue
        assert [tuple(s) for s in row["base"]] == base(row["text"] or ""), row["text"][:80]


def test_secrets_are_found_and_clean_texts_are_left(spark):
    r = random.Random(3)
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n - 2)) + "a1"
    clean = ["The order 1234567890123 of 2024 has version 1a2", "plain words only", "page 4041894974608795 of it", None, ""]
    texts = [f"the of and token = \"{hexa(40)}\" ing" for _ in range(30)] + [f"and password={hexa(18)} of" for _ in range(30)] + clean * 10
    rows = pii.find_spans(frame(spark, texts)).orderBy("doc_id").collect()
    for row in rows[:60]:
        assert [s["kind"] for s in row["spans"]] == [4]
    assert all(not row["spans"] or row["base"] for row in rows[60:])


def test_digest_of_spans_against_brute_force(spark):
    r = random.Random(17)
    parts = ["a@b.c", "x.y@z-1.co.uk", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+12", "word", "é😀"]
    texts = [" ".join(r.choice(parts) for _ in range(r.randint(0, 9))) for _ in range(300)] + [None, ""]
    rows = {x["doc_id"]: x for x in pii.span_digest(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        spans = base(t or "")
        assert [rows[i][c] for c in ("n_email", "n_ip", "n_card", "n_phone")] == [sum(s[1] == k for s in spans) for k in range(4)], t
        told = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert rows[i]["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert set(told.split(",")) - {""} <= set(rows[i]["spans"].split(","))


def test_redaction(spark):
    df = frame(spark, ["mail a@b.co now", None, "clean", "1.2.3.4 and +1 (988) 555-2485"])
    out = pii.redact(df)
    assert out.columns == df.columns
    assert [r["text"] for r in out.orderBy("doc_id").collect()] == ["mail <EMAIL> now", None, "clean", "<IP> and <PHONE>"]
    assert pii.redact(frame(spark, [])).count() == 0


# Lines


@pytest.mark.parametrize(("hot", "block"), [(256, 4096), (2, 3)])
def test_lines_against_brute_force(spark, monkeypatch, hot, block):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    lines = [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(60)]
    texts = []
    for _ in range(60):
        own = []
        for _ in range(r.randint(1, 6)):
            w = r.choice(lines).split(" ")
            if r.random() < 0.5:
                w[r.randrange(len(w))] = r.choice(words)
            own.append(r.choice([" ", "\t", "  "]).join(w).upper() if r.random() < 0.2 else " ".join(w))
        texts.append("\n".join(own))
    texts += [None, "", "\n\n", "one\n\none", "x" * 100_000]
    seen, gone = [], set()
    for d, t in enumerate(texts):
        for no, line in enumerate((t or "").split("\n") if t is not None else []):
            w = line.lower().split()
            s = set(w)
            if w:
                if any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                    gone.add((d, no))
                seen.append(s)
    df = frame(spark, texts)
    assert {tuple(x) for x in line_dedup.later_matches(df).collect()} == gone
    out = {x["doc_id"]: x for x in line_dedup.drop_lines(df).collect()}
    for d, t in enumerate(texts):
        want = None if t is None else "\n".join(line for no, line in enumerate(t.split("\n")) if (d, no) not in gone)
        assert out[d]["text"] == want and out[d]["n_removed"] == sum(g[0] == d for g in gone)
    assert line_dedup.drop_lines(frame(spark, [])).count() == 0
    if hot == 2:
        return
    clash = df.select("*", *(F.lit(7).alias(c) for c in ("row", "id", "of", "gone", "number", "n_lines", "n_removed")))
    again = line_dedup.drop_lines(clash)
    assert again.columns == ["doc_id", "text", "no", "n", "row", "id", "of", "gone", "number", "n_lines", "n_removed"]
    assert {(x["doc_id"], x["text"], x["n_removed"], x["gone"]) for x in again.collect()} == {(x["doc_id"], x["text"], x["n_removed"], 7) for x in out.values()}
    repeated = line_dedup.drop_lines(df.unionAll(df)).groupBy("doc_id", "text").count()
    assert {(x["doc_id"], x["text"], x["count"]) for x in repeated.collect()} == {(x["doc_id"], x["text"], 2) for x in out.values()}
    far = df.withColumn("doc_id", (F.col("doc_id") - 30) * F.lit(1 << 57))
    assert {(x[0] // (1 << 57) + 30, x[1]) for x in line_dedup.later_matches(far).collect()} == gone


def test_one_changed_word_is_found_in_lines_of_ten_words_and_more(spark):
    texts = []
    for k, n in enumerate((10, 20, 30, 40)):
        words = [f"w{k}x{i}" for i in range(n)]
        texts += [" ".join(words), " ".join([*words[: n // 2], "other", *words[n // 2 + 1 :]])]
    assert {tuple(x) for x in line_dedup.later_matches(frame(spark, texts)).collect()} == {(k, 0) for k in (1, 3, 5, 7)}


def test_sets_meet_those_of_sizes_that_may_match(spark, monkeypatch):
    """Lines at a similarity of just 80 % or one word below it, in classes of sizes and partitions of few entries."""
    plans = []
    settle = line_dedup.settle
    monkeypatch.setattr(line_dedup, "settle", lambda df, *a, **k: (plans.append(df._jdf.queryExecution().executedPlan().toString()), settle(df, *a, **k))[1])
    monkeypatch.setattr(line_dedup, "SHARE", 500)
    texts, gone = [], set()
    for k, n in enumerate([*range(4, 68, 4), 100, 128, 400]):
        words = [f"w{k}x{i}" for i in range(n + n // 4 + 1)]
        texts += [" ".join(words[:n]), " ".join(words[: n + n // 4])] if k % 2 else [" ".join(words[: n + n // 4]), " ".join(words[:n])]
        texts += [" ".join(f"y{w}" for w in words[:n]), " ".join(f"y{w}" for w in words)]
        gone.add((4 * k + 1, 0))
    assert {tuple(x) for x in line_dedup.later_matches(frame(spark, texts)).collect()} == gone
    joins = [x for p in plans for x in p.split("\n") if re.search(r"Join \[token#\d+, class#\d+\], \[token#\d+, class#\d+\]", x)]
    assert len(joins) == 1 and "ShuffledHashJoin" in joins[0]


def test_tokens_are_counted_in_few_tasks_and_late_ones_meet_no_larger_sets(spark, monkeypatch):
    """A task for each file would send as many counts as the table has ranges; a set's late tokens aren't in the hash tables."""
    plans, looks = [], []
    settle, hashed, counted = line_dedup.settle, line_dedup.hashed, line_dedup.line_count
    monkeypatch.setattr(line_dedup, "settle", lambda df, *a, **k: (plans.append(df._jdf.queryExecution().executedPlan().toString()), settle(df, *a, **k))[1])
    monkeypatch.setattr(line_dedup, "hashed", lambda lines, *others: (looks.append(others), hashed(lines, *others))[1])
    monkeypatch.setattr(line_dedup, "line_count", lambda text: (looks.append("count"), counted(text))[1])
    monkeypatch.setattr(line_dedup, "HOT", 20)
    words = [f"w{k}" for k in range(2000)]
    rng = random.Random(3)
    near = [" ".join([*words[:30], f"x{k}"]) for k in range(25)]
    far = [" ".join([*rng.sample(words[100:], 30), "common"]) for _ in range(60)]
    df = frame(spark, far)
    assert line_dedup.later_matches(df).count() == 0
    # no list has many lines that are like its earliest: two looks at the texts of candidates, after the first one at all
    assert looks == [("doc_id", "no"), ("id",), ("id",)]
    assert sum("Coalesce " in p for p in plans) == 1
    joined = [p for p in plans if re.search(r"Join \[token#\d+, class#\d+\]", p)]
    assert len(joined) == 1 and joined[0].count("explode(array(CASE WHEN") == 1
    looks.clear()
    assert {tuple(x) for x in line_dedup.later_matches(frame(spark, far + near)).collect()} == {(k, 0) for k in range(61, 85)}
    assert looks == [("doc_id", "no"), ("id",), ("id",), ("id",)]


def test_line_feeds_are_counted(spark):
    texts = [None, "", "a", "\n", "a\n", "\n\n", "a\r\nb\u2028c", "\u00e9\n\U0001f600\n"]
    df = frame(spark, texts).select("doc_id", "text", line_dedup.line_count(F.col("text")).alias("n"))
    assert {r["n"] == (None if r["text"] is None else len(r["text"].split("\n"))) for r in df.collect()} == {True}


# Language


def test_words_are_hashed_once(spark):
    """A filter on the hashes would have them computed twice."""
    lines = ["", " ", "\t\x0b\x0c\r ", "  a \t b", "\r\n\x0b", "\x1c", "\u00a0", "A\x0b\x0bB", "b\ta\r"]
    df = spark.createDataFrame([(7, "\n".join(lines)), (8, None), (None, "a")], "doc_id long, text string")
    found = line_dedup.tokenised(line_dedup.split_lines(df, "doc_id", "text"))
    assert found._jdf.queryExecution().executedPlan().toString().count("xxhash64(lambda") == 1
    words = [set(re.findall(r"[^\x20\x09-\x0D]+", x.lower())) for x in "\n".join(lines).split("\n")]
    assert sorted((r["no"], r["n"]) for r in found.collect()) == [(i, len(w)) for i, w in enumerate(words) if w]


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs.where("doc_id % 2 = 0"), rows=400)
    found = language_id.identify(docs.where("doc_id % 2 = 1"), model, language_id.Evidence(), ["doc_id", "lang"]).toDF("doc_id", "true", "lang", "confidence", "text_lang", "accepted")
    good, n = found.select(F.avg((F.col("lang") == F.col("true")).cast("int")), F.count("*")).first()
    assert n == 500 and good > 0.97
    assert found.where("not accepted").count() == 0


def test_other_evidence_decides_where_the_text_does_not(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.train(docs)
    rows = [(i, r["text"], r["lang"]) for i, r in enumerate(docs.where("lang in ('fr', 'de')").select("text", "lang").collect())]
    rows = [(i, t, f"site{i % 3}.{lang}.example.{lang}", lang) for i, t, lang in rows] + [(9001, "x", "siteX.fr.example.fr", "fr"), (9002, "x", "siteY.de.example.de", "de"), (9003, None, None, None), (9004, "12 34", "a.fr", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, declared string")
    out = {r["doc_id"]: r for r in language_id.identify(df, model, language_id.Evidence(F.col("host"), F.col("declared"), language_id.suffix_of(F.col("host"))), ["doc_id"]).collect()}
    assert out[9001]["lang"] == "fr" and out[9002]["lang"] == "de"
    assert out[9003]["lang"] is None and not out[9003]["accepted"] and out[9004]["lang"] is None


def test_texts_of_no_trained_language_are_not_accepted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs)
    r = random.Random(4)
    texts = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
        "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
        " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(80)),
        "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(600)),
    ]
    found = language_id.identify(frame(spark, texts), model, language_id.Evidence(), ["doc_id"]).collect()
    assert [r["doc_id"] for r in found if r["accepted"]] == []
    assert language_id.identify(docs, model, language_id.Evidence(), ["doc_id"]).where("not accepted").count() == docs.where("coalesce(text, '') = ''").count()


def test_language_without_rows_or_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert language_id.keep_identified(empty).count() == 0
    unlabelled = spark.createDataFrame([(1, "text", None, None)], "doc_id long, text string, lang string, source string")
    assert language_id.identify_documents(unlabelled, ["doc_id"]).first()["accepted"] is False




@pytest.mark.parametrize("html, url, want", [('<html class="x" lang="FR-ca">', "https://A.b.DE/x", ("fr", "a.b.de", "de")), ("<p>", "nothing", (None, None, None))])
def test_declared_host_suffix(spark, html, url, want):
    host = language_id.host_of(F.lit(url))
    assert tuple(spark.range(1).select(language_id.declared_in(F.lit(html)), host, language_id.suffix_of(host)).first()) == want


@pytest.mark.parametrize("html", ['<HTML LANG="de">', "<!doctype html>\n<Html Lang=de>", f'<html prefix="{"og: https://ogp.example/ns# " * 40}" class="a b" lang="de">'])
def test_declared_in_any_case_and_after_long_attributes(spark, html):
    assert spark.range(1).select(language_id.declared_in(F.lit(html))).first()[0] == "de"
    assert spark.range(1).select(language_id.declared_in(F.lit("<HTML " + "x" * 300 + '><p lang="de">'))).first()[0] is None


def test_all_languages_of_the_sample_are_known(spark):
    r = random.Random(6)
    words = {f"l{k:02}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for k in range(40)}
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(40)), lang, "s") for i, lang in enumerate(sorted(words) * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language_id.train(df)
    assert model.languages == sorted(words)
    few = df.where("lang >= 'l30'")
    assert language_id.likelihoods(few, model, F.col("text"), [F.col("lang")]).select("lang", F.array_position("_ll", F.array_max("_ll")).alias("k")).where("substr(lang, 2) <> k - 1").count() == 0


def posterior_by_force(rows, model, base_smoothing):
    """Fused posteriors of (text, host, declared, suffix) rows, each count taken row by row."""
    import numpy as np

    ll, best, n = [], [], []
    for text, *_ in rows:
        h, _ = language_id._trigrams([(text or "").encode()])
        total = model.logp[h].astype(float).sum(0) if len(h) else np.zeros(len(model.languages))
        ll.append(total * (min(len(h), language_id.WEIGHT * len(h) ** 0.5) / max(1, len(h))))
        best.append(int(np.argmax(ll[-1])) if len(h) else None)
        n.append(len(h))
    width = len(model.languages)
    one = np.eye(width)
    tally = lambda keep: sum((one[b] for b, r in zip(best, rows, strict=True) if b is not None and keep(r)), np.zeros(width))
    everywhere = (tally(lambda r: True) + 1) / (tally(lambda r: True).sum() + width)
    domain = lambda host: ".".join(host.split(".")[-2:]) if host and "." in host else host

    def smoothed(counts, own, above):
        counts = np.maximum(counts - own, 0)
        return (counts + base_smoothing * above) / (counts.sum() + base_smoothing)

    out = []
    for (text, host, declared, suffix), l, b in zip(rows, ll, best, strict=True):
        if b is None:
            out.append(None)
            continue
        d = smoothed(tally(lambda r: host is not None and domain(r[1]) == domain(host)), one[b], everywhere)
        h = smoothed(tally(lambda r: host is not None and r[1] == host), one[b], d)
        score = l + np.log(h)
        for k, value in ((2, declared), (3, suffix)):
            if value is not None:
                score = score + np.log(smoothed(tally(lambda r: r[k] == value), one[b], everywhere) / everywhere)
        p = np.exp(score - score.max())
        out.append(p / p.sum())
    return out, best, n


def fused(spark, rows, model):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, text string, host string, declared string, suffix string")
    found = language_id.identify(df, model, language_id.Evidence(F.col("host"), F.col("declared"), F.col("suffix")), ["id"])
    return {r["id"]: r for r in found.collect()}


def test_fused_posteriors_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.train(docs)
    r = random.Random(11)
    texts = [x["text"] for x in docs.select("text").limit(120).collect()]
    rows = []
    for t in texts:
        cut = " ".join((t or "").split()[: r.choice([1, 2, 3, 40])])
        host = r.choice([None, "a.org", "b.org", "x.a.org", "plain", "de.site.de"])
        rows.append((r.choice([cut, cut, None, "", "12 34"]), host, r.choice([None, "en", "fr", "xx"]), r.choice([None, "de", "fr"])))
    want, best, n = posterior_by_force(rows, model, language_id.SMOOTHING)
    got = fused(spark, rows, model)
    for i, p in enumerate(want):
        if p is None:
            assert got[i]["lang"] is None and got[i]["confidence"] == 0.0 and not got[i]["accepted"]
        else:
            assert abs(got[i]["confidence"] - p.max()) < 1e-5 and got[i]["text_lang"] == model.languages[best[i]]
            assert p[model.languages.index(got[i]["lang"])] > p.max() - 1e-5


def test_pages_are_judged_by_text_host_suffix_and_declaration(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    extra = [(90_001, "http://www.x.fr/a?b", '<HTML LANG="FR"><script>the of and</script><p>la les des une</p></HTML>'), (90_002, None, None), (90_003, "no address", ""), (90_003, "no address", "")]
    pages = pages.unionByName(spark.createDataFrame(extra, pages.schema)).withColumn("_host", F.lit(1)).withColumn("_n", F.lit(2))
    model = language_id.train(docs)
    plain = lambda html: re.sub(r"<[^>]*>", " ", re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", html)) if html is not None else None
    rows = []
    table = pages.orderBy("page_id").collect()
    for x in table:
        m = re.match(r"[^:/?#]+://([^/?#]*)", x["url"] or "")
        host = m[1].lower() or None if m else None
        d = re.search(r"(?i)<html[^>]*?\blang\s*=\s*[\"']?([a-z]{2})", x["html"] or "")
        s = re.search(r"\.([a-z]{2})$", host or "")
        rows.append((plain(x["html"]), host, d[1].lower() if d else None, s[1] if s else None))
    want, best, _ = posterior_by_force(rows, model, language_id.SMOOTHING)
    got = language_id.identify_pages(pages, docs).orderBy("page_id").collect()
    assert [g["page_id"] for g in got] == [x["page_id"] for x in table]
    for g, p, b in zip(got, want, best, strict=True):
        if p is None:
            assert g["lang"] is None and not g["accepted"]
        else:
            assert abs(g["confidence"] - p.max()) < 1e-5 and g["text_lang"] == model.languages[b]
    assert [g["lang"] for g in got if g["page_id"] == 90_001] == ["fr"]


def test_kept_documents_keep_all_columns_and_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = docs.where("lang = 'fr'").first()["text"]
    own = [(None, text, "fr", "s", 1), (None, text, "fr", "s", 1), (None, None, None, None, None), (70_001, "zzzz qqqq xxxx " * 50, None, None, 1), (70_002, text * 200, "fr", None, 1), (70_003, "", "fr", "s", 0)]
    df = docs.unionByName(spark.createDataFrame(own, docs.schema))
    df = df.select("*", *(F.lit(3).alias(c) for c in ("_host", "_n", "_ll", "id", "name", "row", "of", "by")))
    out = language_id.keep_identified(df)
    assert out.columns == df.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert kept.count(None) == 2 and 70_002 in kept and 70_001 not in kept and 70_003 not in kept
    assert len(kept) == docs.count() + 3
    assert language_id.keep_identified(df.limit(0)).count() == 0


def test_the_training_sample_is_bounded_by_rows_even_with_equal_keys(spark):
    rows = [(None, f"la les des une {i}", "fr") for i in range(300)] + [(None, "the of and to", "en")] * 300
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=50)
    assert set(model.languages) <= {"en", "fr"} and model.languages


# Personal data: the method's own spans


def test_reliabilities_against_expectation_maximisation_row_by_row():
    import numpy as np

    r = random.Random(5)
    rows = [(1, 0, 1, 0) if r.random() < 0.4 else tuple(r.choice([-1, 0, 0, 1]) for _ in range(4)) for _ in range(400)]
    counted = {v: rows.count(v) for v in set(rows)}
    got = pii.reliabilities([(4, v, float(n)) for v, n in counted.items()], rounds=30)
    v = np.array(rows)
    p = np.where(v.sum(1) > 0, 0.9, 0.1)
    told = []
    for _ in range(30):
        prior = (1 + p.sum()) / (2 + len(p))
        score = np.full(len(p), np.log(prior / (1 - prior)))
        for j in range(4):
            share = {(t, x): ((4 if x == 2 * t - 1 else 1) + (w * (v[:, j] == x)).sum()) / (6 + w.sum()) for t, w in ((1, p), (0, 1 - p)) for x in (-1, 0, 1)}
            score += np.array([np.log(share[1, x] / share[0, x]) if x else 0.0 for x in v[:, j]])
        p = 1 / (1 + np.exp(-np.clip(score, -50, 50)))
        told.append(p.copy())
    for row, belief in zip(rows, told[-1], strict=True):
        assert abs(got[4, row] - (belief if any(row) else 0.0)) < 1e-9
    assert got[4, (1, 0, 1, 0)] > 0.8


ACCOUNT = "DE89 3704 0044 0532 0130 00"


def test_kinds_of_the_method(spark):
    good = [
        ("contact: Dr. Maria Keller called", "name", "Dr. Maria Keller"), ("signed Thomas Miller.", "name", "Thomas Miller"), ("address: 221 Baker Street, London", "address", "221 Baker Street"),
        ("lives at 12 Old Mill Road 90210", "address", "12 Old Mill Road"), (f"IBAN {ACCOUNT} please", "account", ACCOUNT), ("passport no: C12345678 issued", "passport", "C12345678"),
        ("password = a8f3k29dkq01xz7", "secret", "a8f3k29dkq01xz7"), ("token: ghp_1a2B3c4D5e6F7g8H9", "secret", "ghp_1a2B3c4D5e6F7g8H9"), ("phone (212) 555-0187 now", "local_phone", "(212) 555-0187"),
    ]
    bad = ["the 12 Angry Men show", "version 123456789 is out", "DE89 3704 0044 0532 0130 01 is wrong", "in Paul Monday", "order 987654321", "commit 20240101120000", "a b c", "12 Main", "Will went"]
    texts = [t for t, _, _ in good for _ in range(6)] + [t for t in bad for _ in range(6)]
    found = {}
    for row in pii.find_spans(frame(spark, texts)).collect():
        found.setdefault(row["text"], [(pii.KINDS[s["kind"]], row["text"][s["start"] : s["end"]]) for s in row["spans"]])
    for t, kind, span in good:
        assert (kind, span) in found[t], (t, found[t])
    for t in bad:
        assert found[t] == [], (t, found[t])


def test_clashing_columns_of_personal_data(spark):
    names = ("_base", "_cand", "_b", "_spans", "row", "t", "base", "spans", "cand", "p")
    df = frame(spark, ["mail a@b.co now", None, "", "clean"]).select("*", *(F.lit(i).alias(c) for i, c in enumerate(names)))
    df = df.unionAll(df)
    out = pii.redact(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert sorted(str(r["text"]) for r in rows) == sorted(["mail <EMAIL> now", "None", "", "clean"] * 2)
    assert all(r[c] == i for r in rows for i, c in enumerate(names))
    assert pii.find_spans(df).columns == [c for c in df.columns if c not in ("base", "spans")] + ["base", "spans"]


def test_signatures_never_exceed_the_difference_and_tell_small_sets_apart_by_128_bits(spark):
    rng = random.Random(8)
    pairs = []
    for n in (3, 20, 79, 80, 100, 300):
        a = rng.sample(range(-(2**31), 2**31), n)
        b = a[: n - n // 10] + rng.sample(range(-(2**31), 2**31), n // 8)
        pairs.append((a, b))
    rows = [(2 * k + side, len(p[side]), sorted(p[side])) for k, p in enumerate(pairs) for side in (0, 1)]
    table = F.split(F.lit(",".join("0" * 16)), ",").cast("array<tinyint>")
    signed = line_dedup.signed(spark.createDataFrame(rows, "id long, n int, t array<int>"), table, 4, 80)
    left, right = (signed.select(F.shiftright("id", 1).alias("k"), *(F.col(c).alias(f"{c}{z}") for c in ("id", "n", "s", "u"))).where(f"id{z} % 2 = {side}") for side, z in enumerate("lr"))
    bound = line_dedup.apart_at_least(F.col("sl"), F.col("sr"), F.col("ul"), F.col("ur"))
    got = {r["k"]: (r["nl"], r["ul"], r["bound"]) for r in left.join(right, "k").select("k", "nl", "ul", bound.alias("bound")).collect()}
    for k, (a, b) in enumerate(pairs):
        n, wide, least = got[k]
        assert least <= len(set(a) ^ set(b)) and (least > 0) == (a != b)
        assert n < 20 or wide != 0


def test_sieve_holds_for_its_values_and_is_made_by_one_shuffle_of_words(spark, monkeypatch):
    plans = []
    settle = runtime.settle
    monkeypatch.setattr(runtime, "settle", lambda df, **k: plans.append(df._jdf.queryExecution().executedPlan().toString()) or settle(df, **k))
    ids = settle(spark.createDataFrame([(k * 7919,) for k in range(500)] + [(None,)], "id long"))
    held = spark.range(100_000).where(runtime.sieve(ids, F.col("id"))).collect()
    assert {r["id"] for r in held} >= set(range(0, 100_000, 7919)) and len(held) < 40
    assert plans[-1].count("Exchange hashpartitioning") == 1


def test_settle_collects_the_drivers_garbage_and_bounds_the_text_of_plans(spark, monkeypatch):
    calls, bounds = [], []
    monkeypatch.setattr(runtime, "collect_garbage", calls.append)
    for _ in range(2 * runtime.COLLECT_EVERY):
        runtime.settle(spark.range(3))
    assert len(calls) == 2
    with monkeypatch.context() as m:
        m.setattr(type(spark.range(1).write), "parquet", lambda self, path: bounds.append(spark.conf.get(runtime.PLAN_TEXT)))
        m.setattr(type(spark.read), "parquet", lambda self, path: spark.range(1))
        runtime.settle(spark.range(1))
    assert bounds == ["20000"]
    runtime._written.pop()
