"""The pipeline, stage by stage, against brute force over its whole input."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from scopeflow.llm import quality, secrets, tokens
from scopeflow.llm.queries import BYTE_BPE, CAPACITY
from scopeflow.llm.storage import written

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def runs(text):
    w = WORD.findall((text or "").translate(AZ))
    return [tuple(w[k : k + 5]) for k in range(len(w) - 4)], w


def good(crf, text):
    w = WORD.findall(text)
    often = Counter(zip(w, w[1:], w[2:]))
    cover = {k + j for k, x in enumerate(zip(w, w[1:], w[2:])) if often[x] > 1 for j in range(3)}
    if len(w) < 50 or 100 * len(cover) > 50 * len(w):
        return False
    lines = text.split("\n")
    best = {0: (0.0, ()), 1: (0.0, ())}
    for i, line in enumerate(lines):
        own = WORD.findall(line)
        n, size = max(1, len(own)), max(1, len(line.encode()))
        upper, lower = len(re.findall("[A-Z]", line)), len(re.findall("[a-z]", line))
        f = [1, min(1, line.count("|") / n), upper / max(1, upper + lower), min(1, 4 * len(re.findall(r"[#*$%&|<>]", line)) / size), min(1, line.count("!") / n), sum(a == b for a, b in zip(own, own[1:])) / n, len(re.findall("[0-9]", line)) / size]
        emit = {0: 0.0, 1: sum(x * y for x, y in zip(f, crf.weights))}
        if i == 0:
            best = {s: (emit[s], (s,)) for s in (0, 1)}
        else:
            best = {s: max(((best[p][0] + crf.moves[p, s] + emit[s], best[p][1] + (s,)) for p in (1, 0)), key=lambda x: x[0]) for s in (0, 1)}
    labels = best[1][1] if best[1][0] >= best[0][0] else best[0][1]
    return sum(len(WORD.findall(x)) for x, s in zip(lines, labels) if s) / len(w) >= 0.5


def firsts(texts):
    """Ids that are the least of their component."""
    sets = {}
    for i, t in texts.items():
        r, w = runs(t)
        sets[i] = set(r) or ({tuple(w)} if w else set())
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    order = sorted(sets)
    for k, i in enumerate(order):
        for j in order[k + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                comp[max(a, b)] = min(a, b)
    return {i for i in sets if root(i) == i}


def leaks(text, items):
    d = runs(text)[0]
    for m in items:
        if m and set(m) & set(d):
            c = Counter(m)
            for p in range(max(1, len(d) - len(m) + 1)):
                w = Counter(d[p : p + len(m)])
                least = (w & c).total()
                if least >= 0.75 * (w.total() + c.total() - least):
                    return True
    return False


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark, stages):
    docs, after_quality, after_dedup, after_leaks, after_secrets, packed = stages
    assert all(df.columns == docs.columns for df in stages[1:-1])
    crf = quality.train_crf(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {i: t for i, t in texts(docs).items() if good(crf, t or "")}
    assert 0 < len(want) < docs.count() and texts(after_quality) == want
    keep = firsts(want)
    want = {i: t for i, t in want.items() if i in keep}
    assert texts(after_dedup) == want
    items = [runs(r.text)[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {i: t for i, t in want.items() if not leaks(t, items)}
    assert texts(after_leaks) == want
    prose = [re.sub("|".join(p.pattern for p in (secrets.ASSIGN, secrets.LONG_HEX, secrets.ACCESS)), " ", t, flags=re.I) for t in want.values()]
    df = Counter(w for t in prose for w in {x.translate(AZ) for x in re.findall(r"[A-Za-z\x80-\U0010ffff]+", t) if 3 <= len(x.encode()) <= 32})
    order = {w: i + 1 for i, w in enumerate(sorted(df, key=lambda w: (-df[w], w)))}
    assert len(order) <= secrets.TOP  # so the first words are all
    ranks = order | {w: min(k, order.get(w, k)) for w, k in secrets.RANK.items()}
    want = {i: secrets.masked(t, secrets.find_secrets(t, is_secret=lambda v: secrets.guess_cost(v, ranks) >= secrets.MIN_COST)) for i, t in want.items()}
    assert texts(after_secrets) == want
    assert all(r.n_chars == len(r.text) for r in after_secrets.collect())
    encoder = tokens.load(BYTE_BPE)
    sizes, rows = Counter(), packed.collect()
    for r in rows:
        sizes[r.doc_id] += r.length
    assert sizes == {i: len(encoder.encode(t, add_special_tokens=False).ids) for i, t in want.items()}
    source = {r.doc_id: r.source for r in docs.collect()}
    bins = {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append(r)
    assert all(sum(r.length for r in own) <= CAPACITY and len({source[r.doc_id] for r in own}) == len(own) for own in bins.values())


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(repr, corpus_pipeline.run(spark, SF).collect())) == sorted(map(repr, stages[-1].collect()))


def test_empty_input(spark, stages):
    docs = stages[0].limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
    assert docs.count() == 0


def test_near_copies_leave_one_row(spark):
    """Repeated rows, rows without an id and one id with two texts."""
    one, two, three = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, one, "s"), (5, one, "s"), (9, one + " more", "s"), (None, one, "s"), (7, two, "s"), (7, three, "s"), (6, three.upper(), "s")]
    rows += [(None, "only without an id", "s"), (None, "only without an id", "t"), (8, "", "s"), (8, "", "s"), (None, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = corpus_pipeline.minhash_dedup(spark, docs, SF)
    assert got.columns == docs.columns
    want = [(5, one), (7, two), (6, three.upper()), (None, "only without an id"), (8, ""), (8, ""), (None, None)]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(want)
