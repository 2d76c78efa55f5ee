"""Personal data in texts: exact base patterns, and further spans by weak supervision, in DataFrame operations only.

Candidates for further spans - secrets, local telephone numbers, names, addresses, accounts and passports - are looked for by
loose patterns.  Four labelers vote on each for, against or not at all: its form (patterns, checksums), gazetteers (given
names, street words, countries' account formats, known key prefixes, made-up values), the words around it, and its make-up.
Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is for each kind; its posteriors
are soft labels for a final naive Bayes classifier: to the odds that the weighed votes give it adds the evidence of features
that no labeler looks at.  Counts are over all candidates; what reaches the driver is one row for each vote pattern and each
feature value, however large the input.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phaselens.llm.runtime import settle

KINDS = ["email", "ip", "card", "phone", "secret", "local_phone", "name", "address", "account", "passport"]
BASE = KINDS[:4]
#: Character that stands for a separator that can't be inside a match; the text's own ones become another.
BARRED = "\x01"
FOUND = "array<struct<start:int,kind:int,end:int,text:string,before:string,after:string>>"

#: Fixed words and formats of the labelers.
GIVEN_NAMES = (
    "Aisha Alan Albert Alice Amy Ana Andrea Andrew Angela Anna Anne Antonio Barbara Brian Carlos Carol Catherine Charles Charlotte Chloe Christian Christine Christopher Claire Claudia Daniel David Deborah Dennis "
    "Diana Donald Dorothy Edward Elena Elisabeth Elizabeth Emily Emma Eric Ethan Fatima Felix Francesca Francisco Frank George Giulia Gregory Hannah Hans Heather Helen Henry Isabel Isabella Jack Jacob James Jane Janet Jason "
    "Javier Jean Jeffrey Jennifer Jessica Joan John Jonathan Jose Joseph Joshua Juan Judith Julia Julie Karen Karl Katherine Kathleen Kenneth Kevin Klaus Larry Laura Lena Linda Lisa Louis Luca Lucas Lucia Luis Manuel Marco "
    "Margaret Maria Marie Martin Mary Matthew Michael Michelle Miguel Mohammed Monika Nancy Nathalie Nicholas Nicole Nina Olivia Oliver Pablo Pamela Patricia Paul Peter Philippe Pierre Priya Rachel Raymond Rebecca Richard Robert "
    "Ronald Ryan Sabine Samantha Samuel Sandra Sara Sarah Scott Sebastian Sharon Simon Sofia Sophie Stefan Stephanie Stephen Steven Susan Thomas Timothy Ursula Victoria Wei William Wolfgang Yusuf"
).split()
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Mme Monsieur Madame Señor Señora Sr Sra".split()
STREET_WORDS = "Street Avenue Road Boulevard Lane Drive Court Square Terrace Parkway Highway Crescent Close".split()
STREET_SHORT = "St Ave Rd Blvd Ln Dr Ct Sq Ter Pkwy Hwy".split()
#: Length of an account number by country.
ACCOUNT_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
KEY_PREFIXES = "^(?:AKIA|ASIA|ghp_|gho_|github_pat_|sk_live_|sk_test_|pk_live_|xoxb|xoxp|AIza|eyJ|glpat)"
SECRET_CUES = r"(?i)(?:password|passwd|pwd|secret|token|api[_ -]?key|access[_ -]?key|credential)\s*[:=]?\s*[\"']?$"
PHONE_CUES = r"(?i)(?:phone|tel|call|fax|mobile|cell)\W{0,3}$"
PLAIN_CUES = r"(?i)(?:sha1|sha256|md5|commit|checksum|version|isbn|page|figure|order|invoice|item|article|ref)\W{0,3}$"
NAME_CUES = r"(?i)(?:name|dear|contact|regards|signed|sincerely|author|attn|patient|customer|liebe|lieber|cher|chère|estimado|estimada)\W{0,3}$"
PLACE_CUES = r"(?i)(?:saint|mount|lake|port|fort|cape|street|avenue|university of|city of)\W{0,2}$"
ADDRESS_CUES = r"(?i)(?:address|lives? at|lived at|living at|located at|ship to|deliver to|wohnhaft|anschrift|adresse|dirección)\W{0,3}$"
ACCOUNT_CUES = r"(?i)(?:iban|account|konto|kontonummer|compte|cuenta|rekening)\W{0,3}(?:no|nr|number)?\W{0,3}$"
PASSPORT_CUES = r"(?i)(?:passport|passeport|pasaporte|reisepass|passnummer)\W{0,3}(?:no|nr|number|num)?\W{0,3}$"
WORDS = r"(?i)(?:tion|ment|ing|the|and|that|chen|keit|heit|eaux|ción|mente)"
TEST_VALUES = r"(?i)^(?:x+|0+|1+|(?:0123456789)+|abc.*123|example.*|test.*)$"
CALENDAR = r"(?: |^)(?:January|February|March|April|May|June|July|August|September|October|November|December|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)$"

#: Loose patterns by kind, and what a text must hold for a pattern to be tried.
LOOSE = {
    4: (r"(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])[A-Za-z0-9_]{12,}+", "[0-9]"),
    5: (r"(?<![0-9+-])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9-])", "[0-9]{3}[.-][0-9]{4}"),
    6: (rf"(?<![\p{{L}}.])(?:(?:{'|'.join(TITLES)})\.? \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?|(?:{'|'.join(GIVEN_NAMES)}) (?:\p{{Lu}}\. )?\p{{Lu}}\p{{Ll}}+)(?!\p{{L}})", rf"(?:^|\W)(?:{'|'.join(TITLES + GIVEN_NAMES)})\.? \p{{Lu}}"),
    7: (rf"(?<![\p{{L}}0-9])[0-9]{{1,5}}[A-Za-z]? (?:\p{{Lu}}\p{{Ll}}+ ){{1,3}}(?:{'|'.join(STREET_WORDS + STREET_SHORT)})(?!\p{{L}})|(?<!\p{{L}})\p{{Lu}}\p{{Ll}}+(?:straße|strasse|gasse|platz) [0-9]{{1,4}}(?![0-9])", "[0-9]"),
    8: (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}"),
    9: (r"(?<![A-Za-z0-9])(?:[A-Z]{1,2}[0-9]{7,8}|[0-9]{9})(?![A-Za-z0-9])", "[0-9]{7}"),
}


def _located(searched: Column, pattern: str, kind: int) -> Column:
    """Spans (start and end in code points), texts and surroundings of the matches of a pattern that never matches an empty string."""
    p = F.lit(pattern)
    hits, parts = F.regexp_extract_all(searched, p, 0), F.split(searched, pattern, -1)
    none = F.array().cast(FOUND)

    def step(at: Column, pair: Column) -> Column:
        start = at["at"] + F.length(pair["part"])
        end = start + F.length(pair["hit"])
        around = F.right(pair["part"], F.lit(32)).alias("before"), F.left(pair["next"], F.lit(16)).alias("after")
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), pair["hit"].alias("text"), *around)
        return F.struct(end.alias("at"), F.concat(at["found"], F.array(one)).alias("found"))

    pairs = F.zip_with(parts, hits, lambda part, hit: F.struct(part.alias("part"), hit.alias("hit")))
    pairs = F.zip_with(pairs, F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda z, following: F.struct(z["part"].alias("part"), z["hit"].alias("hit"), following.alias("next")))
    pairs = F.filter(pairs, lambda z: z["hit"].isNotNull())
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda s: s["found"])


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end>> of the four base kinds, by start and then kind.

    Each pattern is run in a form that takes time in proportion to the text: runs are entered at their first character
    only, and separators that can't be inside a match are barred beforehand instead of repeating a group.
    """
    nothing = F.array().cast(FOUND)
    clean = F.translate(text, BARRED, "\x02")
    # a dot of a domain stands between two label characters
    dots = F.regexp_replace(clean, r"(?<![A-Za-z0-9-])\.|\.(?![A-Za-z0-9-])", BARRED)
    local = rf"A-Za-z0-9._%+{BARRED}-"
    email = _located(dots, rf"(?:\G|(?<![{local}]))[{local}]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++", 0)
    ip = _located(text, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 1)
    # a separator of a card number stands between two digits
    gaps = F.regexp_replace(clean, r"(?<![0-9])[ -]|[ -](?![0-9])", BARRED)
    card = _located(gaps, r"[0-9][0-9 -]++", 2)
    phone = _located(text, r"\+[0-9][ ().0-9-]+[0-9]", 3)
    small = lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.regexp_replace(F.right(p, F.lit(3)), "^$", "0").try_cast("int"), F.lit(0)) <= 255)
    fits = {
        1: lambda s: F.forall(F.split(s["text"], r"\."), small),
        2: lambda s: F.length(_digits(s["text"])).between(14, 19) & F.call_function("luhn_check", _digits(s["text"])),
        3: lambda s: F.length(_digits(s["text"])).between(10, 15),
    }
    gated = [
        F.when(F.contains(text, F.lit("@")), email).otherwise(nothing),
        F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(ip, fits[1])).otherwise(nothing),
        F.when(text.rlike(r"[0-9][0-9 -]{12}"), F.filter(card, fits[2])).otherwise(nothing),
        F.when(F.contains(text, F.lit("+")), F.filter(phone, fits[3])).otherwise(nothing),
    ]
    return F.array_sort(F.transform(F.concat(*gated), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))


def _account_rest(text: Column) -> Column:
    """The remainder by 97 of an account number as its check rule reads it: the first four characters last, letters as 10 to 35."""
    plain = F.regexp_replace(text, " ", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)


def votes_on(s: Column) -> Column:
    """The four labelers' votes on a candidate (1, -1, or 0 for none): form, gazetteers, words around it, make-up."""
    t, before, after, kind = s["text"], s["before"], s["after"], s["kind"]
    yes, no, none = F.lit(1), F.lit(-1), F.lit(0)
    cue = lambda pattern: F.when(before.rlike(pattern), yes)
    plain = before.rlike(PLAIN_CUES)
    switches = F.size(F.regexp_extract_all(t, F.lit("[0-9][A-Za-z_]+"), 0))
    same = F.regexp_replace(t, r"[^0-9]", "").rlike(r"^(.)\1*$")
    country = F.element_at(F.create_map(*(F.lit(x) for kv in ACCOUNT_LENGTHS.items() for x in kv)), F.substring(t, 1, 2))
    size = F.length(F.regexp_replace(t, " ", ""))
    by_kind = {
        4: (
            F.when(t.rlike("^[0-9]+$|^[0-9]+[a-z]{1,4}$"), no).when(t.rlike("^[0-9a-f]{16,64}$"), yes).otherwise(none),
            F.when(t.rlike(KEY_PREFIXES), yes).when(t.rlike(TEST_VALUES) | t.rlike(WORDS), no).otherwise(none),
            cue(SECRET_CUES).when(plain, no).otherwise(none),
            F.when(switches >= 3, yes).when(switches == 0, no).otherwise(none),
        ),
        5: (
            F.when(t.rlike(r"^\([0-9]{3}\) [0-9]{3}-[0-9]{4}$"), yes).otherwise(none),
            F.when(t.rlike(r"^\(?[01]"), no).otherwise(none),
            cue(PHONE_CUES).when(plain, no).otherwise(none),
            F.when(same, no).otherwise(none),
        ),
        6: (
            F.when(t.rlike(rf"^(?:{'|'.join(TITLES)})[. ]"), yes).otherwise(none),
            F.when(t.rlike(CALENDAR), no).when(t.rlike(rf"(?:^| )(?:{'|'.join(GIVEN_NAMES)}) "), yes).otherwise(none),
            cue(NAME_CUES).when(before.rlike(PLACE_CUES), no).otherwise(none),
            F.when(after.rlike(rf"^ (?:{'|'.join(STREET_WORDS + STREET_SHORT)})(?!\p{{L}})"), no).otherwise(none),
        ),
        7: (
            F.when(after.rlike(r"^,? *(?:[0-9]{4,5}|[A-Z]{2} [0-9]{5}|\p{Lu}\p{Ll}+)"), yes).otherwise(none),
            F.when(t.rlike(rf"(?:{'|'.join(STREET_WORDS)}|straße|strasse|gasse|platz)"), yes).otherwise(none),
            cue(ADDRESS_CUES).when(plain, no).otherwise(none),
            F.when(t.rlike("^0"), no).otherwise(none),
        ),
        8: (
            F.when(_account_rest(t) == 1, yes).otherwise(no),
            F.when(country.isNull() | (country != size), no).otherwise(none),
            cue(ACCOUNT_CUES).when(plain, no).otherwise(none),
            F.when(same, no).otherwise(none),
        ),
        9: (
            F.when(t.rlike("^[0-9]"), no).otherwise(none),
            F.when(t.rlike("^(?:[A-Z]{2}[0-9]{7}|[A-Z][0-9]{8})$"), none).otherwise(no),
            cue(PASSPORT_CUES).when(plain, no).otherwise(none),
            F.when(same, no).otherwise(none),
        ),
    }
    pick = lambda j: reduce(lambda e, kv: e.when(kind == kv[0], kv[1][j]), by_kind.items(), F.when(F.lit(False), none)).otherwise(none)
    return F.array(*(pick(j) for j in range(4)))


def features_of(s: Column) -> Column:
    """What the classifier goes by, each with the kind in front: length, share of digits, case, and the single characters beside it.

    No labeler looks at these as such: votes are on whole forms, lists, words and changes between letters and digits.
    """
    t, k = s["text"], s["kind"].cast("string")
    beside = lambda c: F.when(c == "", "none").when(c.rlike(r"\s"), "space").when(c.rlike(r"[\"'(\[\])]"), "quote").when(c.rlike("[=:]"), "set").when(c.rlike("[.,;!?]"), "stop").otherwise("other")
    return F.array(
        F.concat(k, F.lit(":bias")),
        F.concat(k, F.lit(":length:"), F.least(F.floor(F.length(t) / 8), F.lit(8)).cast("string")),
        F.concat(k, F.lit(":digits:"), F.floor(4 * F.length(_digits(t)) / F.length(t)).cast("string")),
        F.concat(k, F.lit(":case:"), F.when(t == F.lower(t), "lower").when(t == F.upper(t), "upper").otherwise("both")),
        F.concat(k, F.lit(":left:"), beside(F.right(s["before"], F.lit(1)))),
        F.concat(k, F.lit(":right:"), beside(F.left(s["after"], F.lit(1)))),
    )


def candidates(text: Column) -> Column:
    """array<struct<start, kind, end, votes: array<int>, features: array<string>>> of strings that may be personal."""
    nothing = F.array().cast(FOUND)
    found = F.concat(*(F.when(text.rlike(gate), _located(text, pattern, kind)).otherwise(nothing) for kind, (pattern, gate) in LOOSE.items()))
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), votes_on(s).alias("votes"), features_of(s).alias("features")))


#: Counts added to a labeler's right votes.
AGREES = 4.0


def reliabilities(patterns: list[tuple[int, tuple[int, ...], float]], rounds: int = 50) -> dict[tuple[int, tuple[int, ...]], float]:
    """Posteriors by (kind, votes) from counted vote patterns: one-coin-per-vote labelers that err independently given the truth.

    Starts from the majority; a labeler's chances of each vote given the truth are re-estimated with one count added to each, and AGREES
    to the right one: labelers are thought to be better than chance until counts say otherwise.
    Candidates on which nobody votes have a posterior of 0.
    """
    out = {}
    for kind in sorted({k for k, _, _ in patterns}):
        own = [(v, n) for k, v, n in patterns if k == kind]
        belief = {v: 0.9 if sum(v) > 0 else 0.1 for v, _ in own}
        width = len(own[0][0])
        for _ in range(rounds):
            prior = (1 + sum(belief[v] * n for v, n in own)) / (2 + sum(n for _, n in own))
            chance = {}
            for j in range(width):
                for truth in (0, 1):
                    mass = {x: AGREES if x == (1 if truth else -1) else 1.0 for x in (-1, 0, 1)}
                    for v, n in own:
                        mass[v[j]] += n * (belief[v] if truth else 1 - belief[v])
                    total = sum(mass.values())
                    for x, m in mass.items():
                        chance[j, truth, x] = m / total
            for v, _ in own:
                odds = math.log(prior / (1 - prior)) + sum(math.log(chance[j, 1, x] / chance[j, 0, x]) for j, x in enumerate(v) if x)
                belief[v] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
        out |= {(kind, v): belief[v] if any(v) else 0.0 for v, _ in own}
    return out


def classifier(rows: list[tuple[str, float, float]]) -> dict[str, float]:
    """Log odds by feature from (feature, soft count for, soft count against): naive Bayes with one count added to each."""
    total: dict[str, tuple[float, float]] = {f.split(":")[0]: (yes, no) for f, yes, no in rows if f.endswith(":bias")}
    out = {}
    for f, yes, no in rows:
        a, b = total[f.split(":")[0]]
        out[f] = math.log((a + 1) / (b + 1)) if f.endswith(":bias") else math.log((yes + 1) / (a + 2)) - math.log((no + 1) / (b + 2))
    return out


def _spans(df: DataFrame, text: str) -> DataFrame:
    """row (a struct of all columns of ``df``), t (its text, empty for null), base and spans."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = settle(df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), t.alias("t"), base_spans(t).alias("base"), candidates(t).alias("cand")))
    # candidates inside base spans are none
    apart = F.filter("cand", lambda c: ~F.exists("base", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])))
    each = rows.select(F.explode(apart).alias("c")).groupBy("c.kind", "c.votes", "c.features").agg(F.count("*").alias("n"))
    each = settle(each)
    counted = each.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()
    belief = reliabilities([(r["kind"], tuple(r["votes"]), float(r["n"])) for r in counted])
    if not belief:
        return rows.select("row", "t", "base", F.col("base").alias("spans"))
    soft = reduce(lambda e, kv: e.when((F.col("kind") == kv[0][0]) & (F.col("votes") == F.array(*map(F.lit, kv[0][1]))), kv[1]), belief.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)
    feature = each.withColumn("p", soft).select(F.explode("features").alias("f"), (F.col("n") * F.col("p")).alias("yes"), (F.col("n") * (1 - F.col("p"))).alias("no"))
    weights = classifier([(r["f"], r["yes"], r["no"]) for r in feature.groupBy("f").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).orderBy("f").collect()])
    table = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    posterior = F.create_map(*(F.lit(x) for (kind, votes), p in belief.items() for x in (f"{kind}:{','.join(map(str, votes))}", math.log(max(p, 1e-9) / max(1 - p, 1e-9)))))
    # the votes' log odds and the features' evidence; the prior counts once
    voted = lambda c: F.coalesce(F.try_element_at(posterior, F.concat(c["kind"].cast("string"), F.lit(":"), F.array_join(c["votes"], ","))), F.lit(-20.0))
    odds = lambda c: F.aggregate(F.filter(c["features"], lambda f: ~f.endswith(":bias")), voted(c), lambda a, f: a + F.coalesce(F.try_element_at(table, f), F.lit(0.0)))
    more = F.transform(F.filter(apart, lambda c: odds(c) > 0), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    return rows.select("row", "t", "base", F.array_sort(F.concat("base", more)).alias("spans"))


def find_spans(df: DataFrame, text: str = "text", base: str = "base", spans: str = "spans") -> DataFrame:
    """``df`` with two more columns of array<struct<start, kind, end>>: base spans and all spans (KINDS names the kinds).

    Spans count code points, the end is exclusive; they stand by start and then kind.  A null text counts as empty; repeated rows are
    each searched.  Columns of ``df`` named like the new ones are replaced, others may have any names.
    """
    others = [c for c in df.columns if c not in (base, spans)]
    return _spans(df, text).select(*(F.col(f"row.`{c}`").alias(c) for c in others), F.col("base").alias(base), F.col("spans").alias(spans))


def named(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digest(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, numbers of base spans by kind, the hash of the base spans, and all spans, one row per row of ``df``."""
    found = find_spans(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))).drop("text")
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")  # noqa: E731  a second parameter would be the index
    count = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(BASE)]
    return found.select("doc_id", *count, F.sha2(named(F.col("base")), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with each span of ``text`` replaced by its kind in angle brackets; of overlapping spans the earlier, longer one counts.

    Null texts stay null; all columns are kept, whatever their names.
    """
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    t = F.col("t")
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("last"), s["kind"].alias("kind"))))

    def step(a: Column, s: Column) -> Column:
        inside = s["start"] < a["at"]
        out = F.concat(a["out"], F.substring(t, a["at"] + 1, s["start"] - a["at"]), F.element_at(names, s["kind"] + 1))
        return F.struct(F.when(inside, F.greatest(a["at"], -s["last"])).otherwise(-s["last"]).alias("at"), F.when(inside, a["out"]).otherwise(out).alias("out"))

    done = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))))
    old = F.col(f"row.`{text}`")
    return _spans(df, text).select(*((F.when(F.size("spans") > 0, done).otherwise(old) if c == text else F.col(f"row.`{c}`")).alias(c) for c in df.columns))
