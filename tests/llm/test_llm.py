import base64
import math
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from helixlake.llm import abuse, fusion, lattice, leakage, mail, mixing, splitting

# ---- mail ----------------------------------------------------------------------------------------------------------------------------


def test_decode_plain_and_encodings():
    assert mail.decode(None) == ("", []) and mail.decode("") == ("", [])
    assert mail.decode("just text, no header") == ("", ["just text, no header"])
    qp = "Subject: =?utf-8?B?" + base64.b64encode("Größe".encode()).decode() + "?= =?utf-8?Q?_x=3D?=\nContent-Transfer-Encoding: quoted-printable\n\nein=\ns =C3=A9t=C3=A9"
    assert mail.decode(qp) == ("Größe x=", ["eins été"])
    b = "From: a@b\nSubject: s\n  folded\nContent-Type: text/plain; charset=iso-8859-1\nContent-Transfer-Encoding: base64\n\n" + base64.b64encode("été ok".encode("latin-1")).decode() + "\n!!"
    assert mail.decode(b) == ("s folded", ["été ok"])
    assert mail.decode("Subject: x\nContent-Transfer-Encoding: base64\n\nYWJjZ")[1] == ["abc"]
    assert mail.decode("From a@b Thu\nSubject: y\n\nbody")[0] == "y"
    assert mail.decode("Subject: cut")[1] == [""]
    assert mail.repair("imbÃ©cil caf​é") == "imbécil café"


@pytest.mark.parametrize("depth", [11, 12, 13, 3000])
def test_decode_deep_forwards(depth):
    text = "Subject: innermost\nContent-Transfer-Encoding: base64\n\n" + base64.b64encode(b"the leak").decode()
    for i in range(depth):
        text = f"Subject: s{i}\nContent-Type: message/rfc822\n\n" + text
    subject, parts = mail.decode(text)
    assert subject == f"s{depth - 1}" and parts == [*(f"s{i}" for i in reversed(range(depth - 1))), "innermost", "the leak"]
    text = "Subject: m\nContent-Transfer-Encoding: base64\n\n" + base64.b64encode(b"the leak").decode()
    for i in range(min(depth, 30)):
        text = f'Content-Type: multipart/mixed; boundary="b{i}"\n\n--b{i}\n{text}\n--b{i}\ntail {i}\n--b{i}--\n'
    assert mail.decode(text)[1] == ["the leak", *(f"tail {i}" for i in range(min(depth, 30)))]


def test_decode_multipart():
    inner = "--in\r\nContent-Type: text/plain\r\n\r\nplain\r\n--in\r\nContent-Type: text/html\r\n\r\n<p>ht<b>ml</b> &amp; more<br>x</p><style>p{}</style><!-- c -->\r\n--in--\r\n"
    text = (
        "Subject: m\r\nContent-Type: multipart/mixed; boundary=\"out\"\r\n\r\npreamble\r\n--out\r\nContent-Type: multipart/alternative; boundary=in\r\n\r\n" + inner
        + "--out\r\nContent-Type: application/pdf\r\nContent-Transfer-Encoding: base64\r\n\r\nAAAA\r\n--out\r\nContent-Type: text/plain; name=\"n.txt\"\r\nContent-Disposition: attachment\r\n\r\nattached\r\n--out--"
    )
    subject, parts = mail.decode(text)
    assert subject == "m" and [" ".join(p.split()) for p in parts] == ["preamble", "plain", "html & more x", "attached"]


# ---- p2 ------------------------------------------------------------------------------------------------------------------------------


def reads_frame(spark, data):
    schema = "read_id long, file_id long, name string, flag int, reference string, start_pos long, cigar string, quality_score array<long>, ingested_at timestamp_ntz"
    return spark.createDataFrame(data, schema).withColumns({c: F.lit(1) for c in ("nk", "pk", "grp", "size", "source", "n", "root")})


def brute_survivors(data):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    rank = {}
    for rid, _, name, flag, ref, start, cigar, quality, at in data:
        flag = flag or 0
        if flag & 0x900:
            continue
        present = cigar not in (None, "*", "")
        rank[rid] = ((ref is not None) + (start is not None) + present + bool(quality), sum(quality or []), at or datetime.min, -rid)
        find(rid)
        keys = []
        if name and (base := re.sub(r"(#\w+)?(/\d)?(\s.*)?$", "", name)):
            keys.append(("n", base, flag & 0xC0))
        if ref is not None and start is not None and present:
            ops = [(int(n), o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
            clip = lambda o: sum(n for n, _ in __import__("itertools").takewhile(lambda p: p[1] in "SH", o))
            five = start + sum(n for n, o in ops if o in "MDN=X") - 1 + clip(reversed(ops)) if flag & 16 else start - clip(ops)
            keys.append(("p", ref.lower().removeprefix("chr"), flag & 16, five))
        for k in keys:
            a, b = find(rid), find(k)
            parent[a] = b
    members = {}
    for rid in rank:
        members.setdefault(find(rid), []).append(rid)
    return sorted(max(m, key=rank.get) for m in members.values() if len(m) > 1)


def make_reads(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        name = rng.choice([None, "", *(f"q{rng.randrange(n // 2)}{d}" for d in ("", "/1", "#ACG/2", " 1:N:0:X"))])
        flag = rng.choice([0, 16, 0x40, 0x80 | 16, 0x100, 0x800, None, 0x400])
        cigar = rng.choice([None, "*", "", "10M", "3S7M", "7M3S", "2H5M2D3M1S2H", "4M100N6M", "5=1X4="])
        out.append((i, rng.randrange(4), name, flag, rng.choice([None, "chr1", "CHR1", "1", "chrX"]), rng.choice([None, rng.randrange(100, 130)]), cigar, rng.choice([None, [], [1, 2], [3], [2, None]]) if i % 3 else [5], rng.choice([None, datetime(2024, 1, rng.randrange(1, 9))])))
    return [(*r[:7], [q for q in r[7] if q is not None] if r[7] else r[7], r[8]) for r in out]


@pytest.mark.parametrize("seed", [1, 2])
def test_survivors(spark, seed):
    data = make_reads(120, seed)
    got = sorted(r[0] for r in fusion.fuse(reads_frame(spark, data)).select("read_id").collect())
    assert got == brute_survivors(data) and got


def test_fused_values_and_empty(spark):
    day = datetime(2024, 1, 1)
    # Source 9 contradicts the others in every group; its copier 8 repeats its mistakes.
    data = []
    for g in range(12):
        for s in range(5):
            data.append((g * 10 + s, s, f"g{g}", 0, "chr1", 1000 * g, "10M", [30], day))
        data += [(g * 10 + 8, 8, f"g{g}", 0, "chr2", 1000 * g + 500, "9M", [1], day), (g * 10 + 9, 9, f"g{g}", 0, "chr2", 1000 * g + 500, "9M", [1], day)]
    got = fusion.fuse(reads_frame(spark, data)).collect()
    assert len(got) == 12 and {r.size for r in got} == {7}
    assert all((r.reference, r.cigar) == ("chr1", "10M") and r.reference_p > 0.9 for r in got)
    assert fusion.fuse(reads_frame(spark, [])).count() == 0
    assert fusion.fuse(reads_frame(spark, [(1, 1, None, 0, None, None, None, None, None), (2, 1, "", None, None, None, "*", [], None)])).count() == 0
    copies = reads_frame(spark, [(i, 1, "hot", 0, "5", 10, "4M", [1], day) for i in range(500)])
    assert [(r.read_id, r.size) for r in fusion.fuse(copies).collect()] == [(0, 500)]


def compared(spark, claims):
    """Shared values and number of different ones by pair of sources, of claims (grp, source, value)."""
    votes = spark.createDataFrame(claims, "grp string, source string, value string").withColumn("field", F.lit("cigar"))
    same = fusion.Window.partitionBy("grp", "field", "value")
    votes = votes.withColumn("before", F.lag("source").over(same.orderBy("source"))).withColumn("claimants", F.count("value").over(same))
    return {(r.grp, r.source, r.before): (sorted(r.shared), r.differ) for r in fusion._compared(votes).collect()}


def test_sources_are_compared_on_all_values(spark):
    several = compared(spark, [("g", s, v) for s in "AB" for v in "xy"])
    assert several == {("g", "B", "A"): (["x", "y"], 0)}
    between = compared(spark, [("g", "A", "x"), ("g", "B", "y"), ("g", "C", "x")])
    assert between == {("g", "B", "A"): ([], 1), ("g", "C", "A"): (["x"], 0), ("g", "C", "B"): ([], 1)}
    # The last source copies the first, thirty others stand between them.
    many = compared(spark, [("g", f"s{i:02}", "x" if i in (0, 31) else f"v{i % 3}") for i in range(32)] + [("g", "s31", "only")])
    assert many["g", "s31", "s00"] == (["x"], 1)
    assert len(many) == len(set(many)) <= 32 * (fusion.NEAR + 1)


def brute_posterior(claims, code, rounds=2):
    """{(grp, value): p} of claims {grp: {source: value}}: every source against every one before it."""
    acc, dep = {}, {}
    for k in range(rounds + 1):
        p, held = {}, {}
        for g, by in claims.items():
            score = {}
            for s, v in by.items():
                a = acc.get(s, fusion.ACCURACY)
                origin = max((dep[s, b] for b in by if b < s and by[b] == v), default=0.0) if k else 0.0
                score[v] = score.get(v, 0.0) + math.log(fusion.FALSE_VALUES * a / (1 - a)) * (1 - fusion.COPIED * origin)
            top = max(score.values())
            total = sum(math.exp(x - top) for x in score.values())
            p |= {(g, v): math.exp(x - top) / total for v, x in score.items()}
            held[g] = max(score, key=lambda v: (score[v], code[v]))
        if k == rounds:
            return p
        said = {}
        for g, by in claims.items():
            for s, v in by.items():
                said.setdefault(s, []).append(p[g, v])
        acc = {s: min(max((sum(x) + 2 * fusion.ACCURACY) / (len(x) + 2), 0.05), 0.99) for s, x in said.items()}
        odds = {}
        for g, by in claims.items():
            for s in by:
                for b in by:
                    if b < s:
                        a, o = acc[s], acc[b]
                        q = a * o if by[s] == held[g] else (1 - a) * (1 - o) / fusion.FALSE_VALUES
                        step = math.log((fusion.COPIED + (1 - fusion.COPIED) * q) / q) if by[s] == by[b] else math.log(1 - fusion.COPIED)
                        odds[s, b] = odds.get((s, b), math.log(fusion.DEPENDENCE / (1 - fusion.DEPENDENCE))) + step
        dep = {sb: 1 / (1 + math.exp(-x)) for sb, x in odds.items()}


@pytest.mark.parametrize("block", [3, 256])
def test_every_pair_of_sources_is_compared(spark, monkeypatch, block):
    """Fields of more sources than the window holds: posteriors are those of all pairs, and no pair is taken twice."""
    monkeypatch.setattr(fusion, "BLOCK", block)
    rng, cigars = random.Random(3), ["8M", "9M", "10M", "11M"]
    claims = {}
    for g in range(10):
        by = {f"{s}": rng.choices(cigars, [6, 2, 1, 1])[0] for s in range(10, 34) if rng.random() < 0.9}
        # The last source copies the first, over which others stand that claim the same by themselves.
        claims[f"g{g}"] = by | ({"33": by["10"]} if "10" in by else {})
    code = {c: spark.range(1).select(F.xxhash64(F.lit(c))).first()[0] for c in cigars}
    data = [(100 * g + int(s), int(s), name, 0, None, None, c, None, None) for g, (name, by) in enumerate(claims.items()) for s, c in by.items()]
    want = brute_posterior(claims, code)
    got = {r.grp.split(":")[-1].split("|")[0]: r for r in fusion.fuse(reads_frame(spark, data)).collect()}
    assert got.keys() == claims.keys()
    for g, r in got.items():
        assert r.cigar_p == pytest.approx(want[g, r.cigar], rel=1e-9) and r.cigar_p == pytest.approx(max(want[g, c] for c in set(claims[g].values())), rel=1e-9)
    votes = spark.createDataFrame([("g", f"s{i:02}", f"v{i % 3}") for i in range(40)], "grp string, source string, value string").withColumn("field", F.lit("cigar"))
    same = fusion.Window.partitionBy("grp", "field", "value")
    votes = votes.withColumn("before", F.lag("source").over(same.orderBy("source"))).withColumn("claimants", F.count("value").over(same))
    slots = fusion._slots(votes)
    pairs = [(r.source, r.before, r.shared, r.differ) for r in fusion._compared(votes, slots).unionByName(fusion._further(slots)).collect()]
    every = [(i, j) for i in range(40) for j in range(i)]
    assert sorted(pairs) == sorted((f"s{i:02}", f"s{j:02}", [f"v{i % 3}"] if i % 3 == j % 3 else [], int(i % 3 != j % 3)) for i, j in every)


def test_many_votes_do_not_saturate(spark):
    claims = [("g", "cigar", v, f"{v}{i}", None) for v, n in (("x", 900), ("y", 400), ("z", 90)) for i in range(n)]
    got = {r.value: r for r in fusion._vote(spark.createDataFrame(claims, "grp string, field string, value string, source string, before string"), None, None).collect()}
    assert got["x"].p == 1.0 and got["x"].held and got["y"].p < 1e-300
    assert got["z"].log_p < got["y"].log_p < -1000  # still told apart where p is 0


# ---- p3 ------------------------------------------------------------------------------------------------------------------------------


def test_splitting(spark):
    rng = random.Random(5)
    data = []
    for i in range(25):
        s = "".join(rng.choice("ACGT") for _ in range(rng.randrange(5000, 40_000)))
        for _ in range(rng.randrange(6)):
            at, n = rng.randrange(len(s)), rng.choice([5, 9, 10, 60, 400])
            s = s[:at] + rng.choice("nN") * n + s[at + n :]
        data.append((i, f"c{i}", "\n".join(s[k : k + 60] for k in range(0, len(s), 60)) + " 12*-", rng.choice(["dna", None])))
    data += [(90, None, "N" * 20 + "A" * 6000, "dna"), (91, "p", "M" * 7000 + "xX" * 30 + "K" * 900, "protein"), (92, "e", "", "dna"), (93, "z", None, None), (94, "exact", "A" * 6000, "dna"), (95, "allN", "N" * 9000, "dna"), (90, None, "N" * 20 + "A" * 6000, "dna")]
    df = spark.createDataFrame(data, "contig_id long, id string, sequence string, mol_type string").withColumn("pieces", F.lit(0))
    clean = {c: re.sub("[^A-Za-z]", "", s or "") for c, _, s, _ in data}
    want = []
    for c, _, _, kind in data:
        s = clean[c]
        if len(s) > 6000:
            want += [(c, m.start() + 1) for m in re.finditer("[Xx]{10,}" if kind == "protein" else "[Nn]{10,}", s) if m.start() and m.end() < len(s)] or [(c, 0)]
    assert sorted(map(tuple, splitting.found_gaps(df).collect())) == sorted(want)
    by = {}
    for p in splitting.pieces(df.dropDuplicates()).collect():
        by.setdefault(p.contig_id, []).append(p)
    assert set(by) == {c for c, s in clean.items() if len(s) > 6000}
    for c, ps in by.items():
        ps.sort(key=lambda p: p.piece_no)
        s = clean[c]
        assert ps[0].start_pos == 1 and ps[-1].end_pos == len(s) and len({p.name for p in ps}) == len(ps)
        for a, b in zip(ps, ps[1:]):
            assert b.start_pos == a.end_pos - 199 and a.sequence[-200:] == b.sequence[:200]
            assert not a.cut_gap or s[a.end_pos - 1].upper() in "NX" or s[a.end_pos].upper() in "NX"
        assert all(len(p.sequence) <= 6000 and p.sequence == s[p.start_pos - 1 : p.end_pos] for p in ps)
    cut = {(r.contig_id, r.cut_after) for r in splitting.boundaries(df.dropDuplicates()).where("cut_after IS NOT NULL").collect()}
    at_gaps = {(p.contig_id, p.piece_no) for ps in by.values() for p in ps if p.cut_gap}
    assert cut <= at_gaps and len(cut) > 20
    assert splitting.split(df.where("false")).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        splitting.split(df, limit=100, overlap=60)


@pytest.mark.parametrize("n", [20_000, 60_000, 600_000, 6_000_000])
def test_long_records_keep_their_boundaries(n):
    rng, gaps, x = random.Random(n), [], 1000
    while x < n - 1000:
        gaps.append((x, x + rng.randrange(10, 200)))
        x += rng.randrange(500, 2500)
    c = splitting.cuts(n, gaps)
    at = [0, *(x for x, _ in c), n]
    assert all(0 < y - x <= (5800 if i else 6000) for i, (x, y) in enumerate(zip(at, at[1:])))
    assert all(any(a <= x <= b and b - a == k for a, b in gaps) for x, k in c)
    assert len(at) - 1 <= 2 * (1 + -(-(n - 6000) // 5800))
    assert all(k for _, k in c)
    bare = splitting.cuts(n, [])
    assert len(bare) == -(-(n - 6000) // 5800) and not any(k for _, k in bare)


def test_no_usable_gap_is_left_out():
    """The number of cuts outside of gaps is the least possible: brute force over all chains of gap ends."""
    rng = random.Random(11)
    for _ in range(150):
        n = rng.randrange(61, 400)
        gaps = sorted((a, a + rng.choice([1, 3, 12])) for a in rng.sample(range(1, n - 14), rng.randrange(0, 6)))
        gaps = [g for k, g in enumerate(gaps) if k == 0 or g[0] > gaps[k - 1][1]]
        c = splitting.cuts(n, gaps, 60, 5)
        at = [5, *(x for x, _ in c), n]
        assert all(0 < y - x <= 55 for x, y in zip(at, at[1:])), (n, gaps, c)
        assert all(any(a <= x <= b and b - a == k for a, b in gaps) if k else True for x, k in c)
        if len(c) <= 2 * splitting.STRETCH:
            ends = sorted({x for g in gaps for x in g if 5 < x < n})
            least = {5: 0}
            for x in [*ends, n]:
                least[x] = min(v - (-(x - w) // 55) - 1 for w, v in least.items() if w < x)
            assert sum(not k for _, k in c) <= least[n], (n, gaps, c)


# ---- p8 ------------------------------------------------------------------------------------------------------------------------------


def brute_leaks(docs, items, n):
    grams = {}
    for i, t in items:
        w = leakage.words_of(t or "")
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        for part in mail.decode(t)[1]:
            w = leakage.words_of(part)
            out |= {(d, i) for k in range(len(w) - n + 1) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


def test_leaks(spark):
    rng = random.Random(11)
    word = lambda: rng.choice("ab cd ef gh".split())
    items = [(i, " ".join(word() for _ in range(rng.randrange(3, 30)))) for i in range(12)] + [(90, None), (91, ""), (92, "ab cd ef gh ab"), (93, "ab cd ef gh ab")]
    docs = []
    for i in range(60):
        body = " ".join(word() if rng.random() < 0.9 else "zz" for _ in range(rng.randrange(60)))
        docs.append((i, rng.choice(["", "Subject: ab cd ef gh ab cd\n\n", "X: y\nContent-Type: text/html\n\n"]) + body.replace(" ", rng.choice([" ", "\n> ", "<br>", ", "])).title()))
    docs += [(100, None), (101, ""), (102, "Subject: ab cd ef gh ab\n\nnothing"), (103, "x " * 100_000 + "ab cd ef gh ab"), (103, "ab")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(0))
    t = spark.createDataFrame(items, "item_id int, text string").withColumn("doc_id", F.lit(0))
    got = [(r.doc_id, r.item_id) for r in leakage.leaks(d, t, 5).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_leaks(docs, items, 5) and (103, 92) in got and (103, 93) in got
    assert leakage.leaks(d, t.where("false"), 5).count() == 0 and leakage.leaks(d.where("false"), t, 5).count() == 0
    clean = {r.doc_id: r for r in leakage.clean(spark.createDataFrame([(1, "Intro words. Ab, cd; EF gh ab! Outro stays here for good reason."), (2, "ab cd ef gh ab"), (3, None)], "doc_id long, text string"), t.where("item_id = 92"), 5).collect()}
    assert clean[1].text.split() == "Intro words. ! Outro stays here for good reason.".split() and not clean[1].dropped and clean[1].n_leaked == 5
    assert clean[2].dropped and clean[2].text is None and clean[3].n_words == 0


def test_items_of_any_size(spark, monkeypatch):
    """Items that don't fit into one automaton are searched by several, with the same result."""
    items = [(i, " ".join(f"w{i}x{k}" for k in range(8))) for i in range(20)]
    docs = [(i, f"intro {items[i % 20][1]} and {items[(i * 7) % 20][1]}") for i in range(60)]
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    whole = sorted(map(tuple, leakage.leaks(d, t, 5).collect()))
    monkeypatch.setattr(leakage, "MAX_ITEM_WORDS", 30)
    assert sorted(map(tuple, leakage.leaks(d, t, 5).collect())) == whole and len(whole) > 60
    with pytest.raises(ValueError, match="at most 30"):
        leakage.clean(d, t, 5)


def test_automaton_is_bounded():
    words = [random.Random(3).choice("abc") for _ in range(500)]
    a = leakage.SuffixAutomaton([(1, words), (2, words[100:300])])
    assert len(a.next) <= 2 * 700


# ---- p9 ------------------------------------------------------------------------------------------------------------------------------


def test_mixing(spark):
    rng = random.Random(2)
    docs = [(i, rng.choice(["word " * rng.randrange(1, 60), "ein längerer Satz. " * rng.randrange(1, 20), ""]), s) for i, s in enumerate(["big"] * 3000 + ["mid"] * 900 + ["small"] * 150 + ["other"] * 50)]
    docs += [(90_000, None, "mid"), (90_001, "no source", None), (None, "no id here", "big"), (0, docs[0][1], "big")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"h": F.lit(0), "copies": F.lit(9), "n_tokens": F.lit(1)})
    t = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4), ("absent", 0.0, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(d, t).collect()
    assert len(mixed) == len(docs)
    limit = {"big": 1, "mid": 2, "small": 4}
    assert all(0 <= r.copies <= limit.get(r.source, 0) for r in mixed)
    used = {}
    for r in mixed:
        used[r.source] = used.get(r.source, 0) + r.copies * r.n_tokens
    total = sum(used.values())
    assert all(abs(used[s] / total - p) < 0.01 for s, p in (("big", 0.5), ("mid", 0.3), ("small", 0.2)))
    encode = mixing.encoding(mixing.TOKENIZER).encode_ordinary
    assert all(r.n_tokens == len(encode(docs[r.doc_id][1])) for r in mixed[:200] if r.doc_id is not None and r.doc_id < 4000)
    report = {r.source: r for r in mixing.shares(d, t).collect()}
    assert set(report) == limit.keys() and all(report[s].tokens_used == used[s] and report[s].most_copies <= limit[s] for s in limit)
    half = {(r.doc_id, r.source): r.copies for r in mixing.mix(d, t, budget=total / 2).collect()}
    assert all(half[r.doc_id, r.source] <= r.copies for r in mixed if r.doc_id not in (None, 0))  # nested thresholds
    assert mixing.mix(d.where("false"), t).count() == 0 and mixing.shares(d.where("false"), t).count() == 3
    assert {r.copies for r in mixing.mix(d, t.where("false")).collect()} == {0}


# ---- p10 -----------------------------------------------------------------------------------------------------------------------------


def test_restorer():
    lexicon = dict.fromkeys("idiot moron clown parasite naked imbécil versager yourself".split(), 1.0)
    r = lattice.Restorer(lexicon, {"the": 5.0, "plates": 3.0, "and": 5.0, "coverage": 2.0})
    want = {"cl0wn": "clown", "para**te": "parasite", "n@k3d": "naked", "1mbéc1l": "imbécil", "imbecil": "imbécil", "idiooooot": "idiot", "versgaer": "versager", "youreslf": "yourself", "idot": "idiot", "iddiot": "idiot"}
    assert {k: r.restore(k) for k in want} == want
    assert [r.restore(x) for x in ("plates", "2024", "ab", "xantir", "a1b2", "***", "")] == [None] * 7
    assert lattice.join_spaced("you i d i o t, i-d-i-o-t. a b 1.2.3") == "you idiot, idiot. a b 1.2.3"
    assert "идіот".translate(lattice.HOMOGLYPHS) != "идіот"
    assert lattice.Restorer({}, {}).viterbi("abc") is None


TERMS = [("idiot", "abusive"), ("Drell", "group"), ("naked", "sexual"), (None, "abusive"), ("odd", None)]


def test_scores():
    m = abuse.Model([t for t in TERMS if t[0] and t[1]], [])
    at = abuse.CATEGORIES.index
    s = lambda t: m.score("Subject: x\n\n" + t)
    for text, category in [
        ("Shut up, you useless idiot.", "abusive"), ("Shut up, you useless 1d!0t.", "abusive"), ("> I will k!ll\n> you, Bob.", "abusive"), ("Shut up, you iddioot.", "abusive"),
        ("You i" + "d" * 200 + "iot.", "abusive"), ("The D r e l l are vermin.", "hateful"), ("Send me nаkеd pictures of yourself.", "sexual"),
    ]:
        if category == "sexual":
            assert s(text)[at(category)] > abuse.BIAS + 5, text
        else:
            assert s(text)[at(category)] >= abuse.THRESHOLD, text
    for text in ("The idiot light on the pump stays on.", "The Drell festival is on tomorrow.", "The naked shrew strain is weak.", "", "We kill the stuck job."):
        assert max(s(text)) < abuse.THRESHOLD, text
    assert m.score(None) == [abuse.BIAS] * 3 and m.score("Subject: You stupid idiot\n\nok")[0] >= abuse.THRESHOLD


def test_plain_threats_and_contempt_without_labels():
    """Sentences that stand in no table; the model knows no corpus."""
    m = abuse.Model([], [])
    for text, k in [("I will kill you and your whole family tonight", 0), ("All immigrants are parasites and must be exterminated", 1), ("Send nudes or I will leak your pictures", 2), ("Du bist ein Arschloch, dich werde ich umbringen", 0)]:
        assert m.score("Subject: x\n\n" + text)[k] >= abuse.THRESHOLD, text


def _mail(k: int, text: str, reviews: int = 1, named: tuple = (0, 0, 0)) -> abuse.Labelled:
    return abuse.Labelled(f"From: w{k % 9}@a.example\nSubject: a\n\nThe plates are fine. {text}", reviews, named)


def test_labels_teach_new_phrases_and_harmless_uses():
    new = [_mail(i, f"Go boil your head, number {i}.", 1, (1, 0, 0)) for i in range(12)]
    fine = [_mail(i, f"Row {i}.") for i in range(40)] + [_mail(i, "Do you see the idiot light?", 2) for i in range(12)]
    before, after = abuse.Model(TERMS[:3], []), abuse.Model(TERMS[:3], new + fine)
    insult, harmless = "Subject: c\n\nGo boil your head, Ann.", "Subject: c\n\nDo you see the idiot light?"
    assert before.score(insult)[0] < abuse.THRESHOLD <= after.score(insult)[0]
    assert before.score(harmless)[0] >= abuse.THRESHOLD > after.score(harmless)[0]
    # Disguises of words that only the labels taught are undone.
    assert after.score("Subject: c\n\nGo b0il y0ur he4d, Ann.")[0] >= abuse.THRESHOLD


def test_a_signature_is_no_offence():
    """What one sender writes in every message isn't learned, however often their messages offend."""
    own = [abuse.Labelled(f"From: x@a.example\n\nYou idiot, see row {i}.\n\nWarm greetings, Xo Yan", 1, (1, 0, 0)) for i in range(20)]
    m = abuse.Model(TERMS[:3], own + [_mail(i, f"Row {i}.") for i in range(60)])
    assert m.score("Subject: a\n\nThe plates are fine.\n\nWarm greetings, Xo Yan")[0] < abuse.THRESHOLD <= m.score("Subject: a\n\nYou idiot, see row 7.")[0]


def test_held_out_labels():
    """Fitted on half of noisy labels, the model finds what the other half holds; without labels it doesn't (ablation)."""
    rng = random.Random(5)
    say = ["your brain is made of {x} porridge", "somebody should lock you in the {x} cellar", "nobody would miss you at the {x} table"]
    docs = []
    for i in range(900):
        bad = i % 4 == 0
        text = f"Row {i} is done. {rng.choice(say).format(x=rng.choice('old cold blue red'.split())) if bad else 'Somebody should lock the cellar.'}. Thanks."
        docs.append((bad, _mail(i, text, 1, (int(bad != (rng.random() < 0.08)), 0, 0))))
    m = abuse.Model(TERMS[:3], [d for _, d in docs[:450]])
    found = [m.score(d.text)[0] >= abuse.THRESHOLD for _, d in docs[450:]]
    true = [bad for bad, _ in docs[450:]]
    both = sum(a and b for a, b in zip(found, true, strict=True))
    assert both >= 0.9 * sum(true) and both >= 0.9 * sum(found)
    assert not any(abuse.Model(TERMS[:3], []).score(d.text)[0] >= abuse.THRESHOLD for _, d in docs[450:])


def test_every_label_counts(spark):
    """A phrase that only the labelled documents of greatest hash hold is learned, however many others there are."""
    n = 12_060
    ids = [r.id for r in spark.range(n).orderBy(F.xxhash64("id"), "id").collect()]
    last = set(ids[12_000:])
    docs = [(i, _mail(i, f"Go boil your head, number {i}." if i in last else f"Row {i} is done.").text, "s") for i in range(n)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i, "r", "abusive" if i in last else "none") for i in range(n)], "label_id long, doc_id long, reviewer string, category string")
    terms = spark.createDataFrame(TERMS, "term string, category string")
    got = [tuple(r) for r in abuse.found(d, labels, terms).collect()]
    assert sorted(got) == [(i, "abusive") for i in sorted(last)]


def test_driver_and_cluster_fit_the_same_model(spark):
    rng = random.Random(8)
    say = ["Go boil your head", "You 1d!ot, leave", "The Drell are vermin", "Send me naked pictures", "Do you see the idiot light", "All is well", "Warm greetings, Xo Yan"]
    docs = [(i, rng.choice(["", "Subject: s\n\n", f"From: w{i % 7}@a.example\nSubject: a\n\n"]) + " ".join(f"{x}, {rng.randrange(9)}." for x in rng.sample(say, rng.randrange(4))), "s") for i in range(300)]
    docs += [(300, None, "s"), (301, "", "s"), (7, docs[7][1], "s")]
    labels = []
    for i, text, _ in docs[:302]:
        named = [c for c, x in zip(("abusive", "abusive", "hateful", "sexual"), say) if x in (text or "") and rng.random() < 0.9] or ["none"]
        labels += [(len(labels), i, rng.choice(["a", "b", None]), c) for c in named]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    frames = d, spark.createDataFrame(labels, "label_id long, doc_id long, reviewer string, category string"), spark.createDataFrame(TERMS, "term string, category string")
    here, there = abuse.fit(*frames), abuse.fit(*frames, on_driver=0)
    assert here.weights.keys() == there.weights.keys() and len(here.weights) > 30
    assert all(here.weights[g] == pytest.approx(there.weights[g], abs=1e-6) for g in here.weights)
    for part in ("common", "suspects", "starts", "heads"):
        assert getattr(here, part) == getattr(there, part), part
    assert here.restorer.lexicon == there.restorer.lexicon and here.restorer.pairs == there.restorer.pairs
    nothing = abuse.fit(frames[0], frames[1].where("false"), frames[2], on_driver=-1)
    assert nothing.weights == abuse.Model(TERMS[:3], []).weights


def test_abuse_frames(spark):
    long = "Subject: l\n\n" + "The plates are fine. " * 20_000 + "You stupid idiot."
    docs = [(1, "Subject: a\n\nYou stupid idiot.", "s"), (2, None, "s"), (6, "I want you naked", "s"), (3, "", None), (4, "fine", None), (5, long, "t"), (5, long, "t"), (None, "I will kill you", "t")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"category": F.lit("c"), "n": F.lit(0), "evidence": F.lit(0)})
    labels = spark.createDataFrame([(1, 1, "a", "abusive"), (2, 1, "b", "none"), (3, 9, "b", "sexual"), (4, None, None, None), (5, 4, "c", "odd")], "label_id long, doc_id long, reviewer string, category string")
    terms = spark.createDataFrame(TERMS, "term string, category string")
    got = [(r.doc_id, r.category) for r in abuse.found(d, labels, terms).collect()]
    assert sorted(got, key=repr) == sorted([(1, "abusive"), (6, "sexual"), (5, "abusive"), (5, "abusive"), (None, "abusive")], key=repr)
    scored = abuse.document_scores(d, labels, terms)
    assert scored.count() == 3 * len(docs) and all(0 <= r.score <= 1 for r in scored.collect())
    rates = {(r.source, r.category): (r.n_documents, r.n_found, r.rate) for r in abuse.rates(d, labels, terms).collect()}
    assert rates["s", "sexual"] == (3, 1, 1 / 3) and rates[None, "abusive"] == (2, 0, 0.0) and rates["t", "abusive"] == (3, 3, 1.0)
    assert abuse.found(d, labels.where("false"), terms.where("false")).count() >= 3 and abuse.found(d.where("false"), labels, terms).count() == 0
