"""Near duplicates, mixing, language model, archives, pages, pipeline: against brute force."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.llm import html, lm, mixing, neardup, warc

from ..conftest import DATA
from .conftest import prose


def sets_of(docs, k):
    out = []
    for i, t in docs:
        w = (t or "").encode("utf-8", "surrogatepass").lower().split()
        n = min(k, len(w))
        out.append((i, {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if w else set()))
    return out


def components(docs, k, percent):
    """Component of each row by comparing all pairs; a null id is smaller than all."""
    sets = sets_of(docs, k)
    key = lambda i: -1 if i is None else i
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                up[find(a)] = find(b)
    least = {}
    for r in range(len(sets)):
        f = find(r)
        least[f] = min(least.get(f, 10**9), key(sets[r][0]))
    return sorted((key(sets[r][0]), len(sets[r][1]), least[find(r)]) for r in range(len(sets)))


def check(df, docs, k, percent):
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in df.collect())
    assert got == components(docs, k, percent)


def test_near_duplicates_of_odd_rows(spark, edge, edge_docs):
    check(neardup.op9_neardup(spark, edge), [(i, t) for i, t, *_ in edge_docs], 3, 85)


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_of_families(spark, k, percent):
    """Groups of copies with a few words changed, chains, and texts that share a passage; one group is
    larger than a small node."""
    rng = random.Random(3)
    passage = prose(rng, 30)
    texts = [prose(rng, 40) + " " + passage for _ in range(60)]
    for size, change in ((120, 0.03), (30, 0.01), (12, 0.06)):
        base = prose(rng, 120).split(" ")
        texts += [" ".join(prose(rng, 1) if rng.random() < change else w for w in base) for _ in range(size)]
    w = prose(rng, 100).split(" ")
    for i in range(12):  # a chain: each links with the next
        w[i * 8] = "c%d" % i
        texts.append(" ".join(w))
    texts += texts[60:64] * 3
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    check(neardup.near_duplicates(df, shingle=k, percent=percent), docs, k, percent)


def test_rows_that_share_an_id_stay_apart(spark):
    """Ids repeated or null: the right component of each row, and one row of each component stays."""
    import corpus_pipeline as c

    rng = random.Random(9)
    base = [prose(rng, 60) for _ in range(8)]
    near = [b + " more" for b in base]
    docs = [(5, base[0]), (5, base[1]), (3, near[1]), (None, base[2]), (None, base[3]), (7, near[2]), (8, near[3]), (None, base[4]), (None, base[4]), (9, base[5]), (9, near[5]), (9, base[6])]
    docs += [(None, None), (None, None), (4, ""), (None, base[7])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    check(neardup.near_duplicates(df, shingle=5, percent=80), docs, 5, 80)
    kept = sorted(((r.doc_id, r.text) for r in c.near_duplicates(spark, df, "").collect()), key=str)
    nine = [r for r in kept if r in ((9, base[5]), (9, near[5]))]
    assert len(nine) == 1
    assert kept == sorted([(5, base[0]), (3, near[1]), (None, base[2]), (None, base[3]), (None, base[4]), (9, base[6]), (None, base[7]), (None, None), (None, None), (4, ""), *nine], key=str)


@pytest.mark.parametrize(("seed", "lead"), [(131, 30), (241, 8)])
def test_large_nodes_are_compared_whole(spark, monkeypatch, seed, lead):
    """A pair at the threshold that meets only in nodes led by an unlinked text; four more levels of
    branching would part it."""
    monkeypatch.setattr(neardup, "SMALL", 1)
    r = random.Random(seed)
    words = lambda m, k: [f"{k}{r.getrandbits(40):x}" for _ in range(m)]
    s, a, b = words(80, "s"), words(10, "a"), words(10, "b")
    r = random.Random(lead * 1000003 + seed)
    first = s[:]
    first.pop(r.randrange(80))
    first += words(11, "l")
    docs = list(enumerate(" ".join(x) for x in (first, s + a, s + b)))
    check(neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=1, percent=80), docs, 1, 80)


def linked_components(docs, k, percent):
    """As ``components``, by an inverted index, for tables too large for all pairs."""
    sets = sets_of(docs, k)
    at = collections.defaultdict(list)
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    links = []
    for r, (_, x) in enumerate(sets):
        common = collections.Counter(q for s in x for q in at[s])
        for q, c in common.items():
            if 100 * c >= percent * (len(x) + len(sets[q][1]) - c):
                links.append((q, r))
                up[find(q)] = find(r)
        for s in x:
            at[s].append(r)
    return [find(r) for r in range(len(sets))], links


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_recall_on_the_driver_table(spark, k, percent):
    """Every link of a row whose id is divisible by 50, against all rows, and nothing but links."""
    df = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    roots, links = linked_components(docs, k, percent)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, shingle=k, percent=percent).collect()}
    asked = [(a, b) for a, b in links if docs[a][0] % 50 == 0 or docs[b][0] % 50 == 0]
    assert asked and all(got[docs[a][0]] == got[docs[b][0]] for a, b in asked)
    least = {}
    for r, (i, _) in zip(roots, docs, strict=True):
        least[r] = min(least.get(r, i), i)
    assert got == {i: least[r] for r, (i, _) in zip(roots, docs, strict=True)}


@pytest.mark.parametrize("linked", [True, False])
def test_families_over_several_blocks(spark, monkeypatch, linked):
    """Families of which one component is most, and of which most are linked with nothing; many blocks."""
    monkeypatch.setattr(neardup, "SMALL", 6)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    seen = []
    inner = neardup._compare
    monkeypatch.setattr(neardup, "_compare", lambda keyed, *a: seen.append(keyed.select("g", "p", "q").distinct().count()) or inner(keyed, *a))
    rng = random.Random(17)
    base, texts = prose(rng, 90).split(" "), []
    for i in range(160):
        change = (0.004 if i % 3 else 0.03) if linked else 0.045
        texts.append(" ".join(prose(rng, 1) if rng.random() < change else w for w in base))
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    check(neardup.near_duplicates(df, shingle=3, percent=85), docs, 3, 85)
    assert max(seen) > 4


def test_word_hashes_follow_the_words():
    a = neardup.word_hashes(b"one two\tone\x0btwo three")
    assert a[0] == a[2] and a[1] == a[3] and len(set(a.tolist())) == 3 and len(neardup.word_hashes(b" \n")) == 0
    s = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64))
    half = s[: int(len(s) * 0.9)]
    assert abs((neardup.sketch(s) == neardup.sketch(half)).mean() - 0.9) < 0.15


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (102, 100)], "a long, b long")
    got = {r.id: r.comp for r in neardup.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


# ---- mixing ----


def test_mixing_of_odd_rows(spark, edge, edge_docs):
    out = mixing.op7_mixing(spark, edge).collect()
    assert len(out) == len(edge_docs) and all(0 <= r.taken <= 2 * r.size for r in out)
    again = mixing.op7_mixing(spark, edge).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    sizes = collections.Counter()
    for _, t, _, s in edge_docs:
        sizes[s] += len((t or "").encode("utf-8", "surrogatepass").split())
    want = mixing.targets(dict(sizes))
    taken = collections.Counter()
    rows = mixing.mix(spark.read.parquet(f"{edge}/documents.parquet")).collect()
    for r in rows:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    assert all(abs(taken[s] - want[s]) <= 10 for s in want)


def test_targets_share_the_excess():
    t = mixing.targets({"a": 10, "b": 100, "c": 1000, None: 5})
    assert t["a"] == 20 and t["b"] == 200 and sum(t.values()) == pytest.approx(1.5 * 1115) and t[None] <= 10
    assert mixing.targets({}) == {} and mixing.targets({"x": 0}) == {"x": 0.0}


# ---- language model ----


def reference_scores(docs):
    rows = [(i, (t or "").encode("utf-8", "surrogatepass").lower().split() + ["</s>"]) for i, t in docs]
    train = [w for i, w in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    count = collections.Counter(x for w in train for x in w)
    total, vocab = sum(count.values()), len(count)
    pairs = collections.Counter(p for w in train for p in zip(["<s>", *w], w, strict=False))
    ctx, ns, before = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0]), collections.Counter()
    for (a, b), c in pairs.items():
        ctx[a] += c
        ns[a][min(c, 3) - 1] += 1
        before[b] += 1
    d = lm.discounts([sum(c == i for c in pairs.values()) for i in (1, 2, 3, 4)])
    d1 = lm.discounts([sum(c == i for c in before.values()) for i in (1, 2, 3, 4)])
    rest = sum(d1[min(c, 3) - 1] for c in before.values())

    def low(v):
        c = before[v]
        return (max(c - d1[min(c, 3) - 1], 0) if c else 0) / len(pairs) + rest / len(pairs) / (vocab + 1)

    def p(u, v):
        if not total:
            return 1.0
        if u not in ctx:
            return low(v)
        c = pairs[(u, v)]
        return ((max(c - d[min(c, 3) - 1], 0) if c else 0) + sum(x * y for x, y in zip(d, ns[u], strict=True)) * low(v)) / ctx[u]

    out = []
    for i, w in rows:
        base = sum(math.log10((count[x] + 1) / (total + vocab + 1)) for x in w)
        out.append((i, len(w), sum(x in count for x in w), total, base, sum(math.log10(p(u, v)) for u, v in zip(["<s>", *w], w, strict=False))))
    return out, (low, p, count)


def norm(rows):
    return sorted((str(r[0]), r[1], r[2], r[3], round(r[4], 6), round(r[5], 6)) for r in rows)


def test_scores_of_odd_rows(spark, edge, edge_docs):
    want, _ = reference_scores([(i, t) for i, t, *_ in edge_docs])
    got = lm.op6_lm(spark, edge).collect()
    assert norm([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got]) == norm(want)


def test_scores_of_the_driver_table_and_probabilities_sum_to_one(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()]
    want, (low, p, count) = reference_scores(docs)
    got = lm.op6_lm(spark, f"{DATA}/sf0.001").collect()
    assert norm([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got]) == norm(want)
    assert sum(p(b"the", v) for v in count) + p(b"the", "unseen") == pytest.approx(1) and sum(map(low, count)) + low("unseen") == pytest.approx(1)


def test_blocks_round_trip():
    rng = np.random.default_rng(2)
    k = np.unique(rng.integers(0, 2**64 - 1, 1000, dtype=np.uint64))
    assert (lm.unpack(lm.pack(k)) == k).all() and len(lm.unpack(lm.pack(k[:0]))) == 0
    assert (lm._unmix(lm._mix(k)) == k).all()
    a, b = lm.combine([k, k[:10]], [np.ones(len(k), int), np.full(10, 300)])
    assert len(a) == len(k) and b[:10].tolist() == [301] * 10
    assert lm._large(lm._small(b), len(b)).tolist() == b.tolist()


# ---- archives ----


def test_archive_round_trip_of_odd_rows(spark, edge):
    import hashlib

    src = spark.read.parquet(f"{edge}/pages.parquet")
    rows = [(r.page_id, (r.html or "").encode()) for r in src.collect()]
    first = {}
    for i, b in rows:
        k = 2**63 if i is None else i
        first[b] = min(first.get(b, k), k)
    want = sorted((str(i), len(b), hashlib.sha256(b).hexdigest(), *(("response", "None") if len(b) < 100 or first[b] == (2**63 if i is None else i) else ("revisit", str(first[b])))) for i, b in rows)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in warc.op4_warc(spark, edge).collect())
    assert got == want


def test_bundles_are_plain_zstandard_and_seekable(spark, tmp_path):
    import zstandard

    df = spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>" * 3000) for i in range(200)], "page_id long, url string, html string").coalesce(1)
    index = warc.write(df, f"file://{tmp_path}/w")
    rows = index.collect()
    assert len({r.frame for r in rows}) > 3
    path = rows[0].file.removeprefix("file://")
    raw = zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True).read()
    assert raw.count(b"WARC/1.1\r\n") == 200
    back = {r.page_id: r for r in warc.read(index.where("page_id % 7 = 0")).collect()}
    assert back[21].payload == b"<p>21</p>" * 3000 and len(back) == 29


# ---- pages ----


@pytest.fixture(scope="module")
def model():
    return html.fit()


def test_main_text_of_composed_pages(model):
    rng, exact = random.Random(77), 0
    for _ in range(120):
        page, truth = html.compose(rng)
        exact += html.texts_of(model, [page])[0] == "\n".join(" ".join(t.split()) for t in truth)
    assert exact >= 108


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("<p>", ""),
    ("<body><nav class=menu><ul><li><a href=/a>Home</a><li><a href=/b>More</a></ul></nav><article><h1>A title &amp; more</h1><p>First  part\n of the text, which is long enough.<br><p>Second &eacute; part of it, also rather long.</article>"
     "<div class=comments><p>I think so, too!</p></div><footer>&copy; me</footer>", "A title & more\nFirst part of the text, which is long enough.\nSecond é part of it, also rather long."),
])
def test_main_text_of_given_pages(model, page, want):
    assert html.texts_of(model, [page])[0] == want


def test_elements_that_hold_no_text_end_by_the_tree():
    words = lambda page: [t for _, t in html.read(page)[1]]
    assert words("<div><datalist><option>a<option>b</datalist>one</div>two") == ["one", "two"]
    assert words("<select><optgroup><option>a<optgroup><option>b</select>x") == ["x"]
    assert words("<p>a<button>go<div>in</button>b<p>c") == ["ab", "c"]
    assert words("<div><svg><g>icon</div>text") == ["text"]
    assert words("<head><title>t</title><p>body") == ["body"] and words("<head><meta x>words") == ["words"]
    assert words("<script>x</p>") == [] and words("a<script>x</script>b") == ["ab"]


@pytest.mark.parametrize("page", ["<b>" * 250_000 + "<div>x</div>" * 20_000, "<div>" * 100_000 + "</section>" * 50_000, "<option>" * 100_000 + "<optgroup>x" * 20_000, "<span>x" * 100_000 + "</i>" * 100_000 + "<p>y" * 10_000], ids=["inline", "foreign", "options", "spans"])
def test_reading_is_linear(page):
    """A megabyte of unclosed or foreign tags."""
    import time

    began = time.perf_counter()
    html.read(page)
    assert time.perf_counter() - began < 8  # quadratic steps would take an hour


def test_open_elements_end_as_in_a_plain_walk():
    """What ends an open element, told by walking down the whole stack, for random tags."""
    rng, tags = random.Random(2), "ul ol li p td tr table option optgroup select b span div a i dl dt dd template".split()

    def plain(tokens):
        """(tag, depth) of the blocks, by a walk for each token; what is hidden is left out."""
        stack, out = ["html"], []

        def end(wanted, scope):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k] in wanted:
                    return k
                if stack[k] in scope:
                    return 0
            return 0

        for close, tag in tokens:
            hidden = any(t in html.HIDDEN for t in stack)
            if close:
                k = end({tag}, () if tag in html.BLOCKS or tag in html.HIDDEN else html.BLOCKS)
                del stack[k or len(stack) :]
                continue
            if tag in ("option", "optgroup"):
                k = end(html.ENDS[tag], html._SCOPE[tag])
                if k and stack[k] != tag and tag == "optgroup" and stack[k - 1] == "optgroup":
                    k -= 1
                del stack[k or len(stack) :]
                hidden = any(t in html.HIDDEN for t in stack)
            if not hidden and tag in html.BLOCKS:
                k = end({"p"}, html.BLOCKS)
                del stack[k or len(stack) :]
                if tag in html.ENDS:
                    k = end(html.ENDS[tag], html._SCOPE[tag])
                    del stack[k or len(stack) :]
                out.append((tag, sum(t in html.BLOCKS for t in stack)))
            stack.append(tag)
        return out

    for _ in range(3000):
        tokens = [(rng.random() < 0.4, rng.choice(tags)) for _ in range(rng.randint(1, 25))]
        nodes, _ = html.read("".join(f"</{t}>" if c else f"<{t}>" for c, t in tokens))
        depth = [0] * len(nodes)
        for i, x in enumerate(nodes[1:], 1):
            depth[i] = depth[x.up] + 1
        assert [(x.tag, d) for x, d in zip(nodes[1:], depth[1:], strict=True)] == plain(tokens)


def test_siblings_are_counted_whole():
    page = "<article>" + "<p>Some words.</p>" * 150 + "<div>x</div></article>"
    nodes, texts = html.read(page)
    x = html.features(nodes, texts)
    place = x.shape[1] - 4
    assert x[2:, place].tolist() == [*range(150), 150] and x[2:-1, place + 1].tolist() == [150.0] * 150 and x[-1, place + 1] == 1


def test_decoding_is_the_cheapest_of_all():
    """Small trees: every way to keep, drop or split, by exhaustion; and no kept block under a dropped one."""
    import itertools

    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 8))
        nodes = [html.Node("div", -1)]
        for i in range(1, n):
            nodes.append(html.Node("div", int(rng.integers(0, i))))
            nodes[nodes[i].up].down.append(i)
        for x in nodes:
            x.own = int(rng.integers(0, 2)) * 9
        p = rng.random(n)
        keep, drop = -np.log(p), -np.log(1 - p)
        w = [html.OWN if x.own else html.CONTAINER for x in nodes]

        def cost(i, state):
            if state[i] == 2:
                own = min(w[i] * keep[i], w[i] * drop[i]) if nodes[i].own else 0.0
                return html.SPLIT + own + sum(cost(j, state) for j in nodes[i].down) if nodes[i].down else math.inf
            todo, total = [i], 0.0
            while todo:
                j = todo.pop()
                total += w[j] * (keep[j] if state[i] else drop[j])
                todo += nodes[j].down
            return total

        best = min(cost(0, s) for s in itertools.product((0, 1, 2), repeat=n))
        kept = html.decode(nodes, p)
        above = lambda i: [] if i < 0 else [*above(nodes[i].up), i]
        # What was decoded, as states: a subtree that is all kept or all dropped may be one choice or a split.
        options = [s for s in itertools.product((0, 1, 2), repeat=n) if abs(cost(0, s) - best) < 1e-9]

        def outcome(s):
            out = []
            for i in range(n):
                state = next((s[j] for j in above(i) if s[j] != 2), 2)
                out.append(state == 1 or (state == 2 and bool(keep[i] <= drop[i])))
            return out

        assert kept in [outcome(s) for s in options]


def test_pages_of_the_driver_tables(spark):
    import re

    out = html.op3_html(spark, f"{DATA}/sf0.001").collect()
    src = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/sf0.001/pages.parquet").collect()}
    assert len(out) == len(src)
    for r in out:
        inner = re.search(r"<article>(.*?)</article>", src[r.page_id], re.S)[1]
        import html as h

        parts = [" ".join(h.unescape(re.sub(r"</?(?:b|br|i|em|a)\b[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h\d|ul|li|div)\b[^>]*>", inner)]
        assert r.text == "\n".join(x for x in parts if x) and r.n_chars == len(r.text)


# ---- pipeline ----


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    d = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("extra", F.lit(1))
    assert [n for n, _ in c.STAGES] == ["language", "near_duplicates", "decontamination", "secret_scan", "mixture"]
    plain = {r.doc_id: r.text for r in docs.collect()}
    a = c.language(spark, docs, d)
    assert a.columns == docs.columns and a.count() >= 0.98 * len(plain)
    b = c.near_duplicates(spark, docs.unionByName(docs.limit(3)), d)
    comps = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert sorted(r.doc_id for r in b.collect()) == sorted({v for v in comps.values()})
    e = c.decontamination(spark, docs, d)
    assert 0 < e.count() < len(plain) and e.columns == docs.columns
    s = {r.doc_id: r for r in c.secret_scan(spark, docs, d).collect()}
    from .test_text_operators import brute

    for i, t in plain.items():
        if brute(t):
            assert s[i].text != t and s[i].n_chars == len(s[i].text)
        elif s[i].text != t:
            assert "[secret]" in s[i].text
    m = c.mixture(spark, docs, d).collect()
    assert all(r.taken > 0 for r in m)
    assert c.run(spark, d).count() > 0


def test_stages_carry_columns_of_any_name(spark):
    import corpus_pipeline as c

    from .conftest import HELPERS

    d = f"{DATA}/sf0.001"
    plain = spark.read.parquet(f"{d}/documents.parquet").limit(60)
    names = [*HELPERS, "_hits", "n_words", "spans"]
    docs = plain.withColumns({n: F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")) for n in names})
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        rows, bare = out.collect(), stage(spark, plain, d).collect()
        assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in bare)
        assert rows and all(r[n] == f"{n}:{r.doc_id}" for r in rows for n in names)
    assert c.mixture(spark, docs, d).count() == c.mixture(spark, plain, d).count()


def test_pipeline_of_odd_and_empty_tables(spark, edge, empty):
    import corpus_pipeline as c

    assert c.run(spark, edge).count() > 0
    assert c.run(spark, empty).count() == 0
