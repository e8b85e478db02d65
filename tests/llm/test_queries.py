"""Each registered query on small tables of its own, against plain Python; and the pipeline, stage by stage."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievework.llm import contamination, queries, secrets, tokens, toxicity, warc

from .test_llm import ODD, brute_jaccard, edit_distance_inside, prose

run = {k.split("_")[0]: v for k, v in queries.QUERIES.items()}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with odd, null, repeated and near-copy rows; labels with nulls; a benchmark; vectors; pages."""
    rng = random.Random(21)
    key = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=64))
    texts = [*ODD, f'api_key = "{key}" and {"0a" * 16}', f"PASSWORD:hunter2hunter2 AKIA{'Z9' * 10}", f"see {key} there"]
    passage = prose(rng, 60, 5000)
    items = [prose(rng, 20, 3000), "", None, prose(rng, 9, 3000)]
    for k in range(40):
        w = prose(rng, rng.randrange(3, 150), 900).split()
        texts += [" ".join(w), " ".join(w[:-1] + ["edit"])][: 1 + k % 2]
    texts += [f"{prose(rng, 8, 900)} {passage} {prose(rng, 5, 900)}" for _ in range(3)]
    texts += [f"{prose(rng, 30, 900)} {items[0]} {prose(rng, 5, 900)}", items[3]]
    texts += [" ".join(rng.choices(["vile", "zonker", *(f"w{i}" for i in range(30))], k=40)) for _ in range(40)]
    rows = [(i, t, ["en", None, "de"][i % 3], f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[0], rows[3], (None, "no id here", None, None, None)]
    labels = [(r[0], int(r[0] % 4 > 0), int("zonker" in (r[1] or "").split() or "vile" in (r[1] or "").split())) for r in rows[:-3]] + [(None, 1, 1), (3, None, None)]
    x = np.random.default_rng(5).standard_normal((60, 8))
    x[30:45] = x[:15] + 0.05 * x[15:30]
    vecs = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(100, None, 1), (101, [0.0] * 8, 1), (102, [float("nan")] * 8, 1), (103, (3 * x[0]).tolist(), 1), (104, x[0].tolist(), 1), (105, [], 0)]
    html = [None, "", "<p>é</p>", "<p>é</p>", "x" * 70_000, "", "<b>"]
    pages = [(i, None if i == 4 else f"http://h{i % 2}.example/p{i}", h) for i, h in enumerate(html)]
    top = tmp_path_factory.mktemp("tables")
    made = {}
    for name, own, schema in (
        ("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", labels, "doc_id long, quality int, toxic int"),
        ("benchmark", [(i, t) for i, t in enumerate(items)], "item_id long, text string"),
        ("embeddings", vecs, "vec_id long, embedding array<double>, label int"),
        ("pages", pages, "page_id long, url string, html string"),
        ("conversations", [(1, 0, "user", "Hello."), (None, None, None, None)], "conv_id long, turn long, role string, text string"),
    ):
        spark.createDataFrame(own, schema).repartition(3).write.parquet(f"file://{top}/{name}.parquet")
        made[name] = own
    return f"file://{top}", made


def ids(name, text):
    from tokenizers import Tokenizer

    own = ids.__dict__.setdefault(name, Tokenizer.from_file(tokens.vocabulary(name)))
    return np.array([*own.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def plain_kneser_ney(train, texts):
    """Perplexity of each text by a 5-gram model over characters in dictionaries; None without characters."""
    symbol = lambda c: ord(c) if ord(c) < 2048 else 2048 + (ord(c) * 0x9E3779B97F4A7C15 % 2**64 >> 53)
    grams = lambda t: [tuple(x[i : i + 5]) for x in [[0] * 4 + [symbol(c) for c in t]] for i in range(len(t))]
    seen = {5: Counter(g for t in train for g in grams(t))}
    for k in (4, 3, 2, 1):
        seen[k] = Counter(g[1:] for g in seen[k + 1])
    cuts, total, mass = {}, defaultdict(int), defaultdict(float)
    for k in range(1, 6):
        t1, t2, t3, t4 = (sum(c == i for c in seen[k].values()) for i in (1, 2, 3, 4))
        y = t1 / (t1 + 2 * t2) if t1 else 0
        exact = [1 - 2 * y * t2 / t1, 2 - 3 * y * t3 / t2, 3 - 4 * y * t4 / t3 if t4 else 0.5] if min(t1, t2, t3) else [0.5] * 3
        cuts[k] = [min(max(d, 0), i + 1) for i, d in enumerate(exact)]
        for g, c in seen[k].items():
            total[g[:-1]] += c if k > 1 else 0
            mass[g[:-1]] += cuts[k][min(c, 3) - 1] if k > 1 else 0
    whole, spare = sum(seen[1].values()), sum(cuts[1][min(c, 3) - 1] for c in seen[1].values())

    def p(g):
        c = seen[len(g)].get(g, 0)
        own = max(c - cuts[len(g)][min(c, 3) - 1], 0) if c else 0
        if len(g) == 1:
            return own / whole + spare / whole / 4096
        return (own + mass[g[:-1]] * p(g[1:])) / total[g[:-1]] if total.get(g[:-1]) else p(g[1:])

    return [float(np.exp(-np.mean([np.log(p(g)) for g in grams(t)]))) if t else None for t in texts]


def test_op1(spark, tables):
    docs, labels = tables[1]["documents"], tables[1]["labels"]
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    held = {r[0] for r in spark.createDataFrame([(r[0],) for r in docs if r[0] is not None], "i long").where("pmod(xxhash64(i), 5) = 0").collect()}
    perplexity = plain_kneser_ney([r[1] or "" for r in docs if r[0] in good - held], [r[1] for r in docs])
    low = lambda values, q: sorted(values)[max(int(np.ceil(q * len(values))), 1) - 1]
    unseen = [(r[2], np.log(x), len(r[1])) for r, x in zip(docs, perplexity) if r[0] in good & held and x]
    assert len(unseen) >= 5
    spread = lambda n: (1 + 600 / n) ** 0.5

    def drawn(values, q):
        common = low([v for _, v in values], q)
        own = defaultdict(list)
        for lang, v in values:
            own[lang].append(v)
        own.pop(None, None)
        return defaultdict(lambda: common, {k: (len(v) * low(v, q) + 50 * common) / (len(v) + 50) for k, v in own.items()})

    centre = drawn([(lang, x) for lang, x, _ in unseen], 0.5)
    high = drawn([(lang, (x - centre[lang]) / spread(n)) for lang, x, n in unseen], 0.995)
    got = sorted(run["op1"](spark, tables[0]).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["perplexity"] or 0))
    want = sorted(zip(docs, perplexity), key=lambda x: (x[0][0] is None, x[0][0], x[1] or 0))
    assert len(got) == len(want) and {r["kept"] for r in got} == {True, False}
    for r, (d, x) in zip(got, want):
        assert r["doc_id"] == d[0] and r["lang"] == d[2] and (r["perplexity"] is None) == (x is None)
        if x is None:
            assert not r["kept"]
            continue
        assert r["perplexity"] == pytest.approx(x, rel=1e-5)
        over = (np.log(x) - centre[d[2]]) / spread(len(d[1])) - high[d[2]]
        assert r["kept"] == (over <= 0) or abs(over) < 1e-5


def test_op2(spark, tables):
    got = Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in run["op2"](spark, tables[0]).collect())
    want = Counter()
    for doc, text, *_ in tables[1]["documents"]:
        own = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or "") if len(m[1]) >= 12]
        own += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 18]
        own += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 16]
        n = Counter(k for _, k, _ in own)
        digest = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(own))
        want[doc, n[0], n[1], n[2], hashlib.sha256(digest.encode()).hexdigest()] += 1
    assert got == want and sum(sum(k[1:4]) for k in want) >= 4
    spans = {r["doc_id"]: r["spans"] for r in run["op2"](spark, tables[0]).collect()}
    assert "random:4:68" in spans[len(ODD) + 2] and "assign:" in spans[len(ODD)]


@pytest.mark.parametrize("rate", [0.001, 0.3])
def test_op2_added_spans(spark, rate):
    """All spans against the step-up procedure in its plain form: sort the p of a stratum, take the last that is small enough for its rank."""
    rng = random.Random(31)
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = [prose(rng, 30, 900) for _ in range(30)]
    for n in (16, 17, 20, 22, 24, 30, 40, 64, 130):
        for make in (lambda: "".join(rng.choices(signs, k=n)), lambda: "".join(rng.choices("0123456789abcdef", k=n)), lambda: "_".join(prose(rng, 9, 900).split())[: n - 4] + "2024", lambda: "a1" * (n // 2)):
            texts.append(f"{prose(rng, 4, 900)} {make()} x={make()}/{make()}-{make()} é{make()}")
    texts += [None, "", texts[-1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(x["s"], x["e"], x["k"]) for x in r["spans"]] for r in secrets.find(docs, rate).collect()}
    floor = lambda p: int(min(40, -np.log10(max(p, 1e-300))) * 100) / 100
    edges = [16, 20, 24, 32, 40, 48, 64, 96, 128, 10**9]
    base, added, strata = {}, defaultdict(list), defaultdict(list)
    for i, text in enumerate(texts):
        base[i] = [(s, e, k) for s, e, k in secrets.base_spans(text or "")]
        for m in re.finditer("[A-Za-z0-9+/_=-]{16,}", text or ""):
            if not re.search("[0-9]", m[0]) or m[0].isdigit():
                continue
            places, tries = secrets.parts(m[0])
            tested = [(0.9**cuts * np.log10(max(min(1, secrets.battery(m[0][s:e]) * tries), 1e-300)), s - e, s, e) for (s, e), cuts in places.items()]
            taken = []
            for score, _, s, e in sorted(tested):
                if all(e <= a or b <= s for a, b in taken):
                    taken.append((s, e))
                    p = min(1, secrets.battery(m[0][s:e]) * tries)
                    kind = sum(x <= e - s for x in edges)
                    added[i].append((m.start() + s, m.start() + e, kind, floor(p)))
                    strata[kind].append(floor(p))
    least = {}
    for kind, scores in strata.items():
        ranked = sorted(scores, reverse=True)
        passing = [x for k, x in enumerate(ranked, 1) if 10**-x <= rate * sum(y >= x for y in ranked) / len(ranked) * (1 + 1e-12)]
        least[kind] = min(passing, default=99)
    for i in range(len(texts)):
        own = [(s, e, 3) for s, e, kind, x in added[i] if x >= least[kind] and not any(a <= s and e <= b for a, b, _ in base[i])]
        assert got[i] == sorted(base[i] + own, key=lambda x: (x[0], x[2], x[1]))
    assert sum(k == 3 for x in got.values() for _, _, k in x) >= 20


def test_op3(spark, tables):
    own = [(i, np.array(v)) for i, v, _ in tables[1]["embeddings"]]
    good = [(i, v / np.linalg.norm(v)) for i, v in own if v.ndim and len(v) == 8 and np.isfinite(v).all() and np.linalg.norm(v)]
    near = {i: [j for j, w in good if j != i and v @ w >= 0.95] for i, v in good}
    root = {i: i for i, _ in own}
    for _ in own:
        for i in near:
            root[i] = min([root[i], *(root[j] for j in near[i])])
    want = {(i, len(near.get(i, [])), root[i], root[i] == i) for i, _ in own}
    assert {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in run["op3"](spark, tables[0]).collect()} == want
    assert sum(n for _, n, _, _ in want) > 10


def test_op4(spark, tables):
    want = Counter()
    for doc, text, *_ in tables[1]["documents"]:
        for item, t in tables[1]["benchmark"]:
            p = contamination.normal(t)
            if p and edit_distance_inside(p, contamination.normal(text)) <= contamination.budget(len(p)):
                want[doc, item] += 1
    assert Counter((r["doc_id"], r["item_id"]) for r in run["op4"](spark, tables[0]).collect()) == want and len(want) >= 2


def test_op4_signs_between_words(spark, monkeypatch):
    """Any mix of signs is one space, told by a normaliser of its own; items of several passes."""
    plain = lambda t: " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
    docs = [(1, "in new_ york now"), (2, "in new-york now"), (3, "in newyork now"), (4, "__New__--__York__"), (5, "a _-_ b"), (6, "anew york"), (7, "x_y-_z" * 4 + " the _quick_ - brown__fox")]
    items = [(1, "new york"), (2, "NEW _-_ YORK"), (3, "the quick brown fox"), (4, "_"), (5, "a__b")]
    monkeypatch.setattr(contamination, "PASS_BYTES", 12)
    got = {(r["doc_id"], r["item_id"]) for r in contamination.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    holds = lambda p, t: f" {p} " in f" {t} " if contamination.budget(len(p)) == 0 else edit_distance_inside(p, t) <= contamination.budget(len(p))
    want = {(d, i) for d, t in docs for i, x in items if plain(x) and holds(plain(x), plain(t))}
    assert got == want and {(1, 1), (4, 2), (7, 3), (5, 5)} <= got and (6, 1) not in got
    kept = contamination.clean(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_op5(spark, tables):
    got = run["op5"](spark, tables[0]).collect()
    assert len({r["sequence_id"] for r in got}) == len(got) and all(r["offset"] == 0 and r["length"] & (r["length"] - 1) == 0 for r in got)
    texts = defaultdict(list)
    for doc, text, *_ in tables[1]["documents"]:
        texts[doc].append(ids(tokens.BYTE_BPE, text))
    want = Counter()
    for doc, own in texts.items():
        for x in own:
            at = 0
            while at < len(x):
                k = min(2048, 1 << ((len(x) - at).bit_length() - 1))
                want[doc, at, k, zlib.crc32(x[at : at + k].tobytes()), len(x)] += 1
                at += k
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want


def test_op6(spark, tables):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t, *_ in tables[1]["documents"]]
    at = defaultdict(set)
    for k, w in enumerate(texts):
        for i in range(len(w) - 49):
            at[tuple(w[i : i + 50])].add(k)
    want = Counter()
    for k, (doc, *_) in enumerate(tables[1]["documents"]):
        covered = {j for i in range(len(texts[k]) - 49) if len(at[tuple(texts[k][i : i + 50])]) > 1 for j in range(i, i + 50)}
        if covered:
            want[doc, len(texts[k]), len(covered)] += 1
    assert Counter((r["doc_id"], r["n_words"], r["repeated_words"]) for r in run["op6"](spark, tables[0]).collect()) == want and len(want) >= 3


def test_op7(spark, tables):
    want, largest = set(), {}
    for page, _, html in tables[1]["pages"]:
        largest[(html or "").encode()] = max(page, largest.get((html or "").encode(), page))
    for page, _, html in tables[1]["pages"]:
        data = (html or "").encode()
        first = largest[data] == page
        want.add((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else largest[data]))
    assert {(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in run["op7"](spark, tables[0]).collect()} == want


def test_op7_ties_and_lost_entries(spark):
    """Payloads of one page_id and URL come in one order; an index that lacks a record stops the job."""
    rows = [(1, "http://a/", f"<p>{k}</p>" * (k + 1)) for k in (3, 1, 2)] + [(2, "http://a/", "<p>9</p>"), (2, "HTTP://A/", "<p>9</p>")]
    schema, made = "page_id long, url string, html string", []
    for order in (rows, rows[::-1]):
        path = warc.shared_path(spark, "ties")
        runs = warc.write_archives(spark.createDataFrame(order, schema).coalesce(1), path)
        records = warc.read_archives(spark, path, with_payload=True)
        made.append([r["payload"] for r in records.orderBy("file", "offset").collect()])
        index = warc.merge_index(runs).select("file", "offset", F.col("part").alias("index_part"), F.col("pos").alias("index_pos"))
        assert warc.indexed(records, index).count() == len(rows)
        with pytest.raises(Exception, match="record and index differ"):
            warc.indexed(records, index.where("index_pos > 0")).collect()
    assert made[0] == made[1]


def test_op8_sample_passes_over_a_text_that_is_too_long(spark):
    docs = spark.createDataFrame([(k, "long " * 5000 if k % 5 == 0 else f"short {k}") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    texts, toxic = toxicity.sample(docs, labels, size_bytes=1000)
    usable = [k for k in range(40) if k % 5 and zlib.crc32(str(k).encode()) % 3 != 1]
    assert sorted(texts) == sorted(f"short {k}" for k in usable) and len(set(toxic)) == 2


def test_op8(spark, tables, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 40)
    got = run["op8"](spark, tables[0]).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in tables[1]["documents"])
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)


def test_op9(spark, tables):
    got = {(r["doc_id"], r["n_tokens"], r["ids_crc32"]): r["start"] for r in run["op9"](spark, tables[0]).collect()}
    own = [(doc, ids(tokens.WORD_BPE, text)) for doc, text, *_ in tables[1]["documents"]]
    assert {(doc, len(x), zlib.crc32(x.tobytes())) for doc, x in own} == set(got)
    for doc, x in own:
        before = sum(len(y) for other, y in own if other is None or (doc is not None and other < doc)) if doc is not None else 0
        assert got[doc, len(x), zlib.crc32(x.tobytes())] - before in {0, len(x)}  # rows that repeat a doc_id follow each other


def test_op10(spark, tables):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in run["op10"](spark, tables[0]).collect())
    assert got == brute_jaccard(tables[1]["documents"])


def test_pipeline(spark, tables, monkeypatch):
    """Every stage works on what the one before kept, and its decisions take effect."""
    monkeypatch.setattr(toxicity, "STEPS", 120)
    seen = {}
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, tables[0])
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = before.collect(), docs.collect()
        assert docs.columns == columns or name == "packing"
    key = lambda r: (r["doc_id"], r["text"])
    before, after = seen["toxicity"]
    assert {key(r) for r in after} < {key(r) for r in before} and all(key(r) in {key(x) for x in after} for r in before if not r["text"] or r["text"] == "tail ")
    before, after = seen["near copies"]
    component = {i: c for i, _, c in brute_jaccard([(r["doc_id"], r["text"]) for r in before])}
    assert {r["doc_id"] for r in after} == {c for i, c in component.items() if i is not None} | {None for r in before if r["doc_id"] is None}
    before, after = seen["benchmark"]
    holds = lambda t: any((p := contamination.normal(i)) and edit_distance_inside(p, contamination.normal(t)) <= contamination.budget(len(p)) for _, i in tables[1]["benchmark"])
    assert Counter(map(key, after)) == Counter(key(r) for r in before if not holds(r["text"]))
    before, after = seen["secrets"]
    assert Counter(r["doc_id"] for r in before) == Counter(r["doc_id"] for r in after)
    assert not any(secrets.base_spans(r["text"] or "") for r in after) and all(r["n_chars"] is None or r["n_chars"] == len(r["text"] or "") for r in after)
    before, after = seen["packing"]
    want = Counter()
    for r in before:
        want[r["doc_id"]] += len(ids(tokens.BYTE_BPE, r["text"]))
    got = Counter()
    for r in after:
        got[r["doc_id"]] += r["length"]
    assert got == want


def test_pipeline_of_nothing(spark, tables, tmp_path):
    for name, rows in tables[1].items():
        spark.read.parquet(f"{tables[0]}/{name}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
    for query in queries.QUERIES.values():
        assert query(spark, f"file://{tmp_path}").count() == 0


def test_redact_keeps_types_and_columns(spark):
    docs = spark.createDataFrame([(1, "0123456789abcdef0", 3, [1])], "doc_id long, text string, n_chars int, bound array<int>")
    got = secrets.redact(docs)
    assert got.schema == docs.schema and [tuple(r) for r in got.collect()] == [(1, "[secret]", 8, [1])]
