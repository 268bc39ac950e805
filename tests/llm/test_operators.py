"""The ten operators against brute force, and on nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomstead.llm import decontaminate, html_blocks, mil_quality, mixing, ngram_join, quality_rules, suffix_dedup, surrogates, token_shards, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Columns named as the operators' own inner columns are.
EXTRA = ("part", "sig", "uid", "size", "h", "bucket", "row", "votes", "start", "n", "words")


def clashing() -> dict:
    return {c: F.lit(1) for c in EXTRA}


def corpus() -> list[tuple]:
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    out = []
    for i in range(60):
        out.append(" ".join(rng.choice(words) for _ in range(rng.randint(3, 120))))
    for i in range(12):  # near copies, some near the threshold
        base = out[i].split()
        for k in range(rng.randint(1, 4)):
            base[rng.randrange(len(base))] = rng.choice(words)
        out.append(" ".join(base))
    big = " ".join(rng.choice(words) for _ in range(90)).split()
    for i in range(40):  # a group too large for all pairs
        one = list(big)
        for _ in range(rng.randint(0, 5)):
            one[rng.randrange(90)] = rng.choice(words)
        out.append(" ".join(one))
    out += [out[3], out[3], "", None, "one", "two words", "one", "é à ü É", "A a A a A a", "x" * 5000, " \t\n ", " ".join(words * 12)]
    return [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).withColumns(clashing()).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def lower(t: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def test_quality_rules(docs, empty):
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert len(got) == docs.count()
    for i, text, *_ in corpus():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        many = Counter(grams)
        inside = {k + d for k, g in enumerate(grams) if many[g] > 1 for d in range(3)}
        r = got[i]
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(inside))
        assert (r.n_symbols, r.n_dup_lines) == (sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)))
        assert not (r.kept and r.base_failed) and r.base_failed == (len(words) < 50 or 100 * len(inside) > 50 * len(words))
    assert quality_rules.quality_rules(empty).count() == 0


def test_label_model_of_rules():
    n = len(quality_rules.RULES)
    votes = lambda **bad: "".join("-" if r in bad else "+" if i >= n - 3 and r not in bad.get("off", ()) else "0" for i, r in enumerate(quality_rules.RULES))
    clean, both, one, alone = votes(), votes(symbol_share=1, pipe_share=1), votes(pipe_share=1), votes(dup_line_share=1)
    good = lambda found, *names: quality_rules.posterior(list(names), *quality_rules.fit_accuracies(found))
    # A fault that comes with others is believed also where it comes alone; one that never does is the rule's error.
    p = good([(clean, 9000), (both, 300), (one, 40), (alone, 60)], clean, both, one, alone)
    assert p[0] > 0.9 and p[1] < 0.1 and p[2] < 0.5 and p[3] > 0.5
    # Too few documents to tell: the rule is believed.
    p = good([(clean, 900), (alone, 6)], clean, alone)
    assert p[0] > 0.9 and p[1] < 0.5


def test_quality_posterior_against_labels(spark):
    from loomstead.llm import queries

    sf = "/root/testdata/sf0.01"
    judged = queries.op1_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("NOT base_failed AND quality IS NOT NULL")
    rows = [(r.kept, bool(r.quality)) for r in judged.select("kept", "quality").collect()]
    assert sum(a == b for a, b in rows) >= 0.97 * len(rows) and sum(not a for a, _ in rows) > 10


def shard_of(ids, base, least):
    g = token_shards.compress(ids, base, least)
    g["grammar"] = token_shards.Grammar(g)
    g["ends"] = np.cumsum(g["grammar"].size(g["symbols"]))
    return g


def test_re_pair_round_trip():
    rng = np.random.default_rng(0)
    for k in range(80):
        ids = rng.integers(0, rng.integers(1, 40) + 1, rng.integers(1, 2500))
        if k % 3 == 0:
            ids = np.tile(ids, 3)
        least = 2 + k % 3
        g = shard_of(ids, 100, least)
        assert (g["grammar"].expand(g["symbols"]) == ids).all()
        a, b = sorted(rng.integers(0, len(ids) + 1, 2))
        assert (token_shards.slice_ids(g, int(a), int(b)) == ids[a:b]).all()
        assert len(g["symbols"]) <= len(ids) and (g["length"] == [len(g["grammar"].expand(np.array([100 + i]))) for i in range(len(g["left"]))]).all()
        left = Counter(zip(g["symbols"][:-1].tolist(), g["symbols"][1:].tolist(), strict=True))
        assert max(left.values(), default=0) < least  # no frequent pair is left


def test_token_shards(spark, docs, empty, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    odd = [(1000 + i, t, "en", "s", 0) for i, t in enumerate(["It's 3.5, ok... (A,B)?! x.y «z».", "<|endoftext|> a.", "Ünï. é.", "a b ß. 'LL"])]
    rows = sorted([*corpus(), *odd])
    tok, want, at = Tokenizer.from_file(path), {}, 0
    for i, text, *_ in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        want[i], at = (at, ids), at + len(ids)
    whole = docs.select("doc_id", "text").union(spark.createDataFrame(odd, DOCS).select("doc_id", "text"))
    token_shards.write_shards(whole, f"file://{tmp_path}/shards", path, shard_ids=500, partitions=3)
    shards = token_shards.read_shards(spark, f"file://{tmp_path}/shards")
    assert shards.count() == 3
    assert {r.doc_id: r.ids for r in token_shards.decode(shards).collect()} == {i: ids for i, (_, ids) in want.items()}
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    told = {i: (s, len(ids), crc(ids)) for i, (s, ids) in want.items()}
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_shards.digests(shards).collect()} == told
    repeated = spark.createDataFrame([(None, "x y"), (7, "b a"), (7, "a"), (7, "b a"), (None, None)], "doc_id bigint, text string")
    got = sorted((r.start, r.doc_id or 0, r.n_tokens) for r in token_shards.token_digests(repeated, path, partitions=2).collect())
    assert [d for _, d, _ in got] == [0, 0, 7, 7, 7] and all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:]))
    assert token_shards.token_digests(empty, path).count() == 0


def test_words_with_marks_are_encoded_in_groups():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, library = token_shards.WordEncoder(path), Tokenizer.from_file(path)
    told = []

    class Told:
        def encode_batch_fast(self, texts, **options):
            told.extend(texts)
            return library.encode_batch_fast(texts, **options)

    encoder.tokenizer = Told()
    rng = np.random.default_rng(4)
    simple = ["thing", "straße", "été", "ñandú", "ÿ", "thing$$$", "über%%", "a_", "q!?", "heat***"]
    texts = [" ".join(rng.choice(simple, 12)) for _ in range(50)]
    ids, n = encoder(texts, 1)
    want = [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert ids.tolist() == sum(want, []) and n.tolist() == list(map(len, want))
    assert told == []  # the whole tokenizer isn't asked about any of them
    odd = ["Été", "it's", "'s", "###", "x1", "ﬁ", "é", "µm", "ª", "÷", "a÷", "a×b", "<|", "<|endoftext|>", "日本", "ΑΣ", "İ", "a.b", "co-op", "a\u00adb", "$a", "'ll"]
    texts = [" ".join(a + b * (rng.random() < 0.3) for a, b in zip(rng.choice(simple + odd, k), rng.choice(simple + odd, k), strict=True)) for k in rng.integers(0, 20, 400)]
    ids, n = encoder(texts, 1)
    want = [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert ids.tolist() == sum(want, []) and n.tolist() == list(map(len, want))


def test_shared_keys_shuffle_once(spark):
    from loomstead.session import written

    rng = np.random.default_rng(8)
    rows = [(int(k), int(s)) for k, s in zip(rng.integers(0, 300, 800), rng.integers(-40, 40, 800), strict=True)]
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = ngram_join._shared(written(spark.createDataFrame(rows, "key bigint, sig bigint")))
        found = sorted((r.key, r.sig, r.pivot, r.m) for r in got.collect())
        plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    sets = {k: [s for key, s in rows if key == k] for k, _ in rows}
    assert found == sorted((k, s, min(sets[k]), len(sets[k])) for k, s in rows if len(set(sets[k])) > 1)
    assert plan.count("- Exchange ") == 1 and plan.count("- ReusedExchange ") == 1


def labelled(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 7))) for _ in range(200)]
    rows, labels = [], []
    for i in range(240):
        text = [rng.choice(words) for _ in range(rng.randint(60, 200))]
        toxic, good = int(i % 4 == 0), int(i % 3 != 0)
        if toxic:
            for w in ("zorgish", "blarg"):
                text[rng.randrange(len(text))] = w
        if not good:
            text = [w.upper() + "!!" for w in text]
        rows.append((i, " ".join(text) + ".", "en", "s", 0))
        labels.append((i, good, toxic))
    rows += [(900, None, "en", "s", 0), (901, "", "en", "s", 0)]
    labels += [(902, None, None), (903, 1, 0)]
    return spark.createDataFrame(rows, DOCS).withColumns(clashing()), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), labels


def test_classifiers_on_held_out_rows(spark, empty):
    docs, labels, truth = labelled(spark)
    kind = {i: (q, t) for i, q, t in truth}
    learn = F.col("doc_id") % 5 != 0
    for made, column in ((mil_quality.mil_quality(docs, labels, learn_from=learn), 0), (toxicity.toxicity(docs, labels, learn_from=learn), 1)):
        rows = made.collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
        held = [r for r in rows if r.doc_id % 5 == 0 and r.doc_id < 900]
        assert sum(r.predicted == kind[r.doc_id][column] for r in held) >= 0.95 * len(held)
    none = labels.where("doc_id > 900")
    assert mil_quality.mil_quality(docs, none, learn_from=learn).where("score = 0.5").count() == docs.count()
    assert toxicity.toxicity(docs, none, learn_from=learn).where("score = 0").count() == docs.count()
    assert toxicity.toxicity(empty, labels, learn_from=learn).count() == 0 and mil_quality.mil_quality(empty, labels, learn_from=learn).count() == 0


def test_toxicity_voters_and_model():
    lexicon = frozenset({"zorgish"}), frozenset({"blarg"})
    names = lambda text: {v for v, i in toxicity._BIT.items() if toxicity.votes_of(text, toxicity.words_of(text), lexicon) >> i & 1}
    assert names("calm words " * 30) == {"no_hit", "calm"} and names("CALM words! " * 30) == {"no_hit"} and names("short") == names("") == names(None) == set()
    assert "disguised" in names("you i d i o t here") and "disguised" in names("such an 1d10t") and "disguised" not in names("a b c d and x86 4th")
    assert {"repeated", "dense"} < names("zorgish blarging idiot") and names("zorgish " + "fine " * 80) & {"no_hit", "calm"} == {"calm"}
    # Two of three toxic voters echo each other: their correlation is found, and a lone echo counts for less.
    bit = lambda *vs: sum(1 << toxicity._BIT[v] for v in vs)
    clean = bit("no_hit", "calm")
    counts = {clean: 9000, bit("starting", "words0", "stems0"): 300, bit("starting", "stems0"): 60, bit("words1", "words2"): 80, bit("starting"): 20, 0: 100}
    belief, rate, corr = toxicity.label_model(counts)
    assert belief[clean] < 0.05 and belief[bit("starting", "words0", "stems0")] > 0.95
    assert corr[toxicity._BIT["words1"], toxicity._BIT["words2"]] > 0.5 and rate[0, toxicity._BIT["no_hit"]] > rate[1, toxicity._BIT["no_hit"]]


PAGE = """<html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><a href="/">Home</a></nav>
<header>Site</header><div class="cookie-notice">We use cookies</div><div class="sidebar"><p>Related words of the day and the week and the year in short and so on for long.</p></div>
<article class="has-sidebar"><h1>The &amp; title</h1><p>First   paragraph<br>of the   text, which is rather long and has the words that are common in it.<p>Ok.
<ul><li><a href="/x">only a link here</a></li></ul><p>Last &#233; line&nbsp;here.</p><form>Name</form><div id="comments"><p>great post</p></div></article><footer>foot</footer></body></html>"""


def test_html_blocks(spark):
    assert html_blocks.extract(PAGE) == "The & title\nFirst paragraph of the text, which is rather long and has the words that are common in it.\nOk.\nLast é line here."
    plain = "<div><p>" + "the story of the man and the sea was long and it is told in many of the ports. " * 4 + "</p><p>Short.</p></div><ul><li><a>Home</a></li></ul>"
    assert html_blocks.extract(plain).endswith("ports.\nShort.")
    for odd in (None, "", "<", "<p", "&#x110000;", "<script>", "<p>" * 3000 + "x"):
        html_blocks.extract(odd)
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (2, None, None)], "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    assert sorted(r.n_chars for r in html_blocks.extract_main_text(pages).collect())[:2] == [0, 0]


def test_surrogates(spark, empty):
    rows = [
        (1, "Mail jo.doe@mail.example.com or JO.DOE@MAIL.EXAMPLE.COM, call +1 (212) 555-0199.", "en", "s", 0), (2, "4111 1111 1111 1111 is 4111111111111111; +1 (212) 555-0199", "en", "s", 0),
        (3, "Frau Anna Schmidt und Herr Karl Schmidt, г-жа Анна Иванова; 10.1.2.3 and 123-45-6789", "de", "s", 0), (4, "clean text", "en", "s", 0), (5, None, "en", "s", 0), (6, "", "en", "s", 0),
        (7, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "en", "s", 0), (1, "Mail jo.doe@mail.example.com or JO.DOE@MAIL.EXAMPLE.COM, call +1 (212) 555-0199.", "en", "s", 0),
    ]
    docs = spark.createDataFrame(rows, DOCS).withColumns(clashing())
    got = defaultdict(list)
    for r in surrogates.replace_private(docs).collect():
        got[r.doc_id].append(r)
    assert len(got[1]) == 2 and got[1][0] == got[1][1] and got[1][0].n_entities == 3
    a, b = re.findall(r"\S+@[A-Za-z.]+", got[1][0].text)
    assert a.upper() == b.rstrip(",").upper() and b.isupper() and a.endswith(".com") and "jo.doe" not in a
    phone = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[1][0].text)[0]
    assert phone != "+1 (212) 555-0199" and phone in got[2][0].text
    spaced, plain = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", got[2][0].text)
    assert spaced.replace(" ", "") == plain != "4111111111111111"
    luhn = sum(d if k % 2 else (2 * d if d < 5 else 2 * d - 9) for k, d in enumerate(map(int, plain)))
    assert luhn % 10 == 0
    assert re.fullmatch(r"Frau \w+ \w+ und Herr \w+ \w+, г-жа [А-Яа-я]+ [А-Яа-я]+; \d+\.\d+\.\d+\.\d+ and \d{3}-\d{2}-\d{4}", got[3][0].text) and "Schmidt" not in got[3][0].text
    assert got[4][0].text == "clean text" and got[5][0].text is None and got[6][0].text == "" and re.search('"[0-9a-f]{40}"', got[7][0].text)
    assert surrogates.replace_private(empty).count() == 0


def test_surrogates_stay_distinct(spark):
    made = surrogates.assign(spark.createDataFrame([("ssn", f"{i:02d}") for i in range(30)], "kind string, norm string"))
    got = made.collect()
    assert len(got) == len({r.surrogate for r in got}) == 30


def test_decontaminate(spark, docs, empty):
    texts = [t or "" for _, t, *_ in corpus()]
    w = texts[5].split() + texts[6].split()
    items = [(1, " ".join(w[3:25])), (2, "one"), (3, "TWO words"), (4, None), (5, " ".join(texts[20].split()[:10])), (6, " ".join(texts[20].split()[:10])), (7, "no such passage here"), (8, "a a a")]
    split = lambda t: [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or "")) if x]
    windows = defaultdict(set)
    for i, t in items:
        x = split(t)
        for s in range(max(1, len(x) - 9)) if x else []:
            windows[tuple(x[s : s + 10])].add(str(i))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench).collect()}
    assert len(got) == docs.count()
    for i, text, *_ in corpus():
        x, hit, found = split(text), set(), set()
        for win, ids in windows.items():
            for s in range(len(x) - len(win) + 1):
                if tuple(x[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    found |= ids
        r = got[i]
        assert (r.n_words, r.n_hit, r.items, r.contaminated) == (len(x), len(hit), sorted(found), bool(hit))
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(empty, bench).count() == 0


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=str)
    total, sources = sum(r["size"] for r in rows), defaultdict(list)
    for r in rows:
        sources[r.source].append(r)
        assert r.taken <= 3 * r["size"] and (r.taken % r["size"] == 0 if r["size"] else r.taken == 0)
    order = sorted((s for s in sources if s is not None)) + [None]
    size = {s: sum(r["size"] for r in v) for s, v in sources.items()}
    weight, target, left = {s: k % 3 + 1 for k, s in enumerate(order)}, {}, float(total)
    while todo := [s for s in order if s not in target]:
        unit = left / sum(weight[s] for s in todo)
        full = [s for s in todo if unit * weight[s] > 3 * size[s]]
        for s in full or todo:
            target[s] = 3.0 * size[s] if full else unit * weight[s]
        left -= sum(target[s] for s in full)
    for s, v in sources.items():
        assert abs(v[0].target - target[s]) < 1e-6 and abs(sum(r.taken for r in v) - target[s]) <= 2
    assert mixing.mix(empty).count() == 0


def test_fill_meets_budgets_it_can_meet():
    rng = random.Random(2)
    for _ in range(60):
        sizes = sorted(rng.sample(range(1, 60), rng.randint(1, 8)))
        counts = [rng.randint(1, 5) for _ in sizes]
        budget = rng.randint(0, sum(s * n for s, n in zip(sizes, counts, strict=True)))
        took = mixing.fill(sizes, counts, budget)
        assert all(0 <= took[s] <= n for s, n in zip(sizes, counts, strict=True))
    assert sum(s * n for s, n in mixing.fill([3, 5, 7], [100, 100, 100], 601).items()) == 601


def test_fill_is_nearest():
    """Against all choices, also where few large documents are to be taken or left."""
    rng = random.Random(6)
    cases = [([60_000, 400_000], [1, 1], 300_000), ([1000, 1_000_000], [100, 1], 700_000), ([300_000, 450_000, 500_000], [2, 1, 1], 700_000)]
    cases += [([a, a + rng.randint(1, 200_000), a + 200_001], [rng.randint(0, 4) for _ in range(3)], rng.randint(1, 2_000_000)) for a in (rng.randint(1, 300_000) for _ in range(40))]
    for sizes, counts, budget in cases:
        sums = {0}
        for s, n in zip(sizes, counts, strict=True):
            sums = {t + s * k for t in sums for k in range(n + 1)}
        took = mixing.fill(sizes, counts, budget)
        assert all(0 <= took[s] <= n for s, n in zip(sizes, counts, strict=True))
        assert abs(sum(s * k for s, k in took.items()) - budget) == min(abs(t - budget) for t in sums)


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80)])
def test_ngram_join(docs, empty, width, percent, monkeypatch):
    sets, parent = {}, {}
    for i, text, *_ in corpus():
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n_links = Counter()
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
                n_links.update((a, b))
    monkeypatch.setattr(ngram_join, "COUNTED", 16)  # several blocks a component
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    got = {r.doc_id: r for r in ngram_join.ngram_components(docs, width=width, percent=percent, links=True).collect()}
    assert len({r.component_id for r in got.values()}) < len(got) - 15
    for i in sets:
        assert (got[i].n_shingles, got[i].component_id, got[i].n_links) == (len(sets[i]), root(i), n_links[i])
    assert ngram_join.ngram_components(empty, links=True).count() == 0


def test_pairs_of_unlike_sets_are_dropped_early(spark):
    """Sets too unlike in size make no pair, long sets with nothing in common no candidate; no link is lost."""
    rng = np.random.default_rng(5)
    every = lambda n: np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
    sets = [every(n) for n in (40, 44, 60, 61, 64, 120, 250, 255, 400, 3000, 5000, 5200, 8000, 8200, 20_000, 70_000)]
    for s in [*sets]:  # near copies, also with the next number of bits
        for gone, new in ((len(s) // 25, len(s) // 50), (0, len(s) // 10), (len(s) // 10, 0)):
            sets.append(np.unique(np.concatenate([rng.permutation(s)[gone:], every(new)])))
    sigs = [ngram_join.signature(s) for s in sets]
    near, linked = set(), set()
    for percent in (90, 80):
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                o = len(np.intersect1d(x, y)) if sigs[i] < sigs[j] and min(len(x), len(y)) * 2 >= max(len(x), len(y)) else 0
                if o and 100 * o >= percent * (len(x) + len(y) - o):
                    linked.add((percent, sigs[i], sigs[j]))
        groups = spark.createDataFrame([(1, s) for s in sigs], "key bigint, sig bigint")
        met = ngram_join._met(groups, percent)
        assert met.count() < len(sets) * (len(sets) - 1) / 4
        reps = spark.createDataFrame([(s, len(x), ngram_join.parity(x).tolist()) for s, x in zip(sigs, sets, strict=True)], "sig bigint, n int, bits array<bigint>")
        near |= {(percent, r.a, r.b) for r in ngram_join._close(met, reps, percent).collect()}
    assert len({len(ngram_join.parity(x)) for x in sets}) > 5
    assert linked and linked <= near
    size = dict(zip(sigs, map(len, sets), strict=True))
    root = {s: i % 16 if i < 16 else (i - 16) // 3 for i, s in enumerate(sigs)}
    assert not [(p, size[a], size[b]) for p, a, b in near if root[a] != root[b] and min(size[a], size[b]) < 65_000]

    for percent in (90, 80):  # the same by blocks
        rows = [(m, s, i, len(x), ngram_join.parity(x).tolist()) for m in (True, False) for i, (s, x) in enumerate(zip(sigs, sets, strict=True))]
        table = pa.table(dict(zip(("minor", "sig", "root", "n", "bits"), map(list, zip(*rows, strict=True)), strict=True)))
        found = ngram_join._cross(percent)(table).to_pylist()
        assert {(percent, r["a"], r["b"]) for r in found} == {x for x in near if x[0] == percent}


@pytest.mark.parametrize("block, items", [(2048, 1 << 20), (64, 5000)])
def test_sets_left_by_a_pivot_make_no_list_of_pairs(spark, monkeypatch, block, items):
    """Near copies of which most are too far from their pivot: no table of pairs is much longer than that of the sets."""
    from loomstead.session import written

    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(150)]
    texts = []
    for _ in range(500):
        one = list(base)
        for _ in range(rng.choice((1, 2, 3, 3, 4, 4, 5))):
            one[rng.randrange(150)] = rng.choice(words)
        texts.append(" ".join(one))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    want = [root(i) for i in range(len(texts))]
    assert 2 < len(set(want)) < 300
    tables = []

    def counted(df):
        tables.append((df.columns, written(df)))
        return tables[-1][1]

    monkeypatch.setattr(ngram_join, "written", counted)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "COUNTED_ITEMS", items)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(df, width=5, percent=80).collect()}
    assert got == dict(enumerate(want))
    rows = [t.count() for columns, t in tables if columns[:2] == ["a", "b"]]
    assert rows and max(rows) <= 4 * len(texts), rows


def test_loser_tree_merges_without_recomparing():
    rng = np.random.default_rng(3)
    for k in (1, 2, 3, 7, 12):
        runs = [sorted(bytes(rng.choice(list(b"ab"), 12).astype(np.uint8)) for _ in range(rng.integers(0, 20))) for _ in range(k)]
        coded = [suffix_dedup.front_code(np.frombuffer(b"".join(r), np.uint8).reshape(-1, 12)) for r in runs]
        tree = suffix_dedup.LoserTree([suffix_dedup.read_run(*c, 12) for c in coded])
        out, before = [], b""
        for n, s, _ in tree:
            assert n == suffix_dedup.common_prefix(before, s)
            out.append(s)
            before = s
        assert out == sorted(s for r in runs for s in r)


@pytest.mark.parametrize("small", [False, True])
def test_suffix_dedup(spark, docs, empty, monkeypatch, small):
    if small:  # many blocks, parts and ranges
        for name, value in (("BUCKET_BYTES", 20_000), ("SEEDS_A_PART", 500), ("SUFFIXES_A_PART", 300)):
            monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(5)
    more = [(500 + i, "".join(rng.choice("ab") for _ in range(rng.randint(40, 200))) + ("é" * 70 if i % 3 else ""), "en", "s", 0) for i in range(25)] + [(None, corpus()[0][1], "en", "s", 0)]
    passage = " ".join(f"hot{i}" for i in range(12))
    more = [(600 + i, f"{rng.random()} {passage} {rng.random()}" if i % 4 else passage[: 45 + i % 9], "en", "s", 0) for i in range(80)] + more
    whole = docs.select("doc_id", "text").union(spark.createDataFrame(more, DOCS).select("doc_id", "text"))
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(whole, block_bytes=4000 if small else 8 << 20).collect()}
    seen: set[bytes] = set()
    for i, text, *_ in sorted([*corpus(), *more[:-1]]):
        b = (text or "").encode()
        own = [b[k : k + 50] for k in range(len(b) - 49)]
        gone = bytearray(len(b))
        for k, s in enumerate(own):
            if s in seen:
                gone[k : k + 50] = b"\1" * 50
        seen.update(own)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept)
    assert got[None].n_removed == 0 and suffix_dedup.remove_repeats(empty).count() == 0
