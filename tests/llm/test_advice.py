"""Cases of the reviewer's advice in which an operator once did less than the whole job."""

import random
import re

import pytest

from loomstead.llm import html_blocks, ngram_join, surrogates


def test_ngram_join_links_across_the_pair_bound(spark):
    words = [f"w{i}" for i in range(300)]
    short = [" ".join([*words[:173], f"s{i}"]) for i in range(60)]  # 170 shingles of five words, 169 of them common
    long = [" ".join([*words[:211], f"l{i}"]) for i in range(100)]  # 208 shingles; Jaccard with a short set 169 / 209
    docs = spark.createDataFrame(list(enumerate(short + long)), "doc_id bigint, text string")
    got = ngram_join.ngram_components(docs, width=5, percent=80).collect()
    assert {r.n_shingles for r in got} == {170, 208}
    assert len(got) == 160 and {r.component_id for r in got} == {0}


LINE = "This is the long text of the article, and it has as many of the common words as it takes to be kept."


@pytest.mark.parametrize("tag", ["svg", "math", "object", "canvas", "iframe"])
def test_html_self_closed_elements_are_empty(tag):
    page = f"<html><head><{tag} class='x'/></head><body><article><p>{LINE}</p><svg><{tag}/>icon</svg><p>{LINE}</p></article></body></html>"
    assert html_blocks.extract(page) == f"{LINE}\n{LINE}"


@pytest.mark.parametrize("tag", ["button", "select", "noscript", "object"])
def test_html_elements_left_open_end(tag):
    assert html_blocks.extract(f"<body><div><{tag}>label</div><article><p>{LINE}</p></article></body>") == LINE
    assert html_blocks.extract(f"<body><article><{tag}>label<p>{LINE}</p><p>{LINE}</p></article></body>") == f"{LINE}\n{LINE}"
    assert html_blocks.extract(f"<body><article><{tag}>label<p>{LINE}</p><{tag}>closed</{tag}><p>{LINE}</p></article></body>") == f"{LINE}\n{LINE}"
    # Closed ones are left out whole, with the blocks in them.
    assert html_blocks.extract(f"<body><article><p>{LINE}</p><{tag}>label<div><p>{LINE}</p></div></{tag}></article></body>") == LINE


def test_html_text_elements_hold_tags():
    page = f"<body><article><p>{LINE}</p><textarea></p></article><p>{LINE}</textarea><select><option>a<option>b<p>{LINE}</p></article></body>"
    assert html_blocks.extract(page) == f"{LINE}\n{LINE}"
    assert html_blocks.extract("<button><p>x</p>" * 20_000) == ""


PRIVATE = [
    ("Frau Anna Maria Schmidt", "Anna Maria Schmidt"), ("Mr McDonald", "McDonald Donald"), ("Ms Smith-Jones", "Smith Jones"), ("Mr O'Brien", "Brien"), ("Mr J. Smith", "Smith"),
    ("Mr J.R. Smith", "Smith"), ("Herr Karl Otto Emil Weber", "Karl Otto Emil Weber"), ("write to jo@x.com-", "jo@"), ("write to jo@x.com--call", "jo@"), ("write to jo@x.com.2024", "jo@"),
    ("SSN123-45-6789", "123-45-6789"), ("Card4111111111111111", "4111111111111111"), ("host10.20.30.40", "10.20.30.40"), ("7Mr Smith", "Smith"),
]


def test_surrogates_leave_no_part(spark):
    rows = [(i, t) for i, (t, _) in enumerate(PRIVATE)] + [(100, "Mr Smith Mrs Jones"), (101, "card x41111111111111112 and SKU12-34")]
    got = {r.doc_id: r for r in surrogates.replace_private(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, (text, parts) in enumerate(PRIVATE):
        assert got[i].n_entities == 1, text
        assert not any(p in got[i].text for p in parts.split()), (text, got[i].text)
    assert got[100].n_entities == 2 and re.fullmatch(r"Mr \w+ Mrs \w+", got[100].text)
    assert got[101].n_entities == 0


def test_ngram_join_on_a_large_group_and_a_common_line(spark):
    """500 near copies, of which a few are just too far, and as many other texts, all with one line in common."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(4000)]
    line = [f"line{i}" for i in range(12)]
    base = [rng.choice(words) for _ in range(120)]
    texts = []
    for _ in range(500):
        one = list(base)
        for _ in range(rng.choice((0, 1, 1, 2, 3, 5))):
            one[rng.randrange(120)] = rng.choice(words)
        texts.append(" ".join(one + line))
    texts += [" ".join([rng.choice(words) for _ in range(rng.randint(1, 30))] + line) for _ in range(300)]
    texts += [" ".join([rng.choice(words[:3])] + line) for _ in range(200)]
    sets = [{tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n_links = [0] * len(texts)
    for a in range(len(texts)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if 100 * o >= 90 * (len(sets[a]) + len(sets[b]) - o):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
                n_links[a] += 1
                n_links[b] += 1
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: (r.component_id, r.n_links) for r in ngram_join.ngram_components(df, links=True).collect()}
    assert got == {i: (root(i), n_links[i]) for i in range(len(texts))}


def test_surrogates_of_one_number_in_two_formats(spark):
    rows = [(1, "call +1 (212) 555-0199 or +12125550199, in Berlin +49 30 1234567 or +49301234567."), (2, "+1-212-555-0199")]
    got = [r.text for r in surrogates.replace_private(spark.createDataFrame(rows, "doc_id bigint, text string")).orderBy("doc_id").collect()]
    digits = lambda t: [re.sub(r"\D", "", x) for x in re.findall(r"\+[\d ()-]*\d", t)]
    a, b, c, d = digits(got[0])
    assert a == b == digits(got[1])[0] and c == d and a != "12125550199" and a[0] == "1" and c[:2] == "49" and c != "49301234567"


def test_surrogate_names_differ_whatever_their_case_or_gender(spark):
    names = [(i, f"{('Mr', 'Ms')[i % 2]} Karo{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(300)]
    got = surrogates.replace_private(spark.createDataFrame(names, "doc_id bigint, text string")).collect()
    assert len({r.text.split(" ", 1)[1].lower() for r in got}) == 300
