"""Whitening, Merkle manifest and packing against plain computations by definition."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from fixtures import ODD, SF, docs, long_text
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from threadloom.llm import merkle, packing, queries
from threadloom.llm.whitening import _exact_products, eigenvectors, whiten


# 11

def by_row(found, key):
    rows = defaultdict(dict)
    for r in found.collect():
        rows[r[key]][r.component] = r
    return rows


def test_whitening_of_all_vectors(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = {r.vec_id: np.floor(64 * np.array(r.embedding, float)).astype(np.int64) + 1_000_000 for r in table.collect()}
    fit = np.unique(np.array(list(rows.values())), axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    value, vector = np.linalg.eigh(centred.T @ centred / n)
    value, vector = value[::-1][:16], vector[:, ::-1][:, :16]
    trace = (centred ** 2).sum() / n
    found = by_row(queries.op11_whitening(spark, SF), "vec_id")
    assert found.keys() == rows.keys() and all(len(r) == 16 for r in found.values())
    got = np.array([[found[i][c].whitened for c in range(1, 17)] for i in rows])
    want = np.array([(x - sums / n) @ vector / np.sqrt(value) for x in rows.values()])
    sign = np.sign((got * want).sum(0))
    assert np.abs(got * sign - want).max() < 1e-9
    for i, x in rows.items():
        one = found[i][1]
        assert (one.n, one.deviation) == (n, int(((n * x - sums) ** 2).sum())) and one.identity_error < 1e-12
    first = found[next(iter(rows))]
    assert np.allclose([first[c].explained for c in range(1, 17)], value / trace, rtol=1e-12)


def test_whitening_of_odd_vectors(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 2.0]), (None, [5.0, 2.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]),
            (6, [float("inf"), 1.0]), (7, []), (8, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("x", "n", "component", "i")})
    found = whiten(df)
    got = sorted(((str(r.vec_id), r.component, r.n, r.deviation, None if r.whitened is None else round(abs(r.whitened), 9), r.explained) for r in found.collect()),
                 key=repr)
    s = round(1.5 ** 0.5, 9)
    # The second entry never varies; of (1, 3, 5) the mean is 3. The vector of length 3 is alone.
    wide = 3 * 64 * 2
    want = [("1", 1, 3, wide ** 2, s, 1.0), ("1", 1, 3, wide ** 2, s, 1.0), ("2", 1, 3, 0, 0.0, 1.0), ("None", 1, 3, wide ** 2, s, 1.0),
            *[(i, 2, 3, d, None, 0.0) for i, d in (("1", wide ** 2), ("1", wide ** 2), ("2", 0), ("None", wide ** 2))],
            *[("8", c, 1, 0, None, None) for c in (1, 2, 3)]]
    assert got == sorted(want, key=repr)
    assert max(r.identity_error for r in found.collect() if r.identity_error is not None) < 1e-12
    assert whiten(df.limit(0)).count() == 0


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [1] * 6, [1, 1 + 1e-9, 1 + 2e-9, 0.5, 0.1], [1, 1, 1, 1e-6, 0, 0],
                                    [1 + 1e-13 * i for i in range(20)], list(np.geomspace(1, 1e-8, 40)), [0, 0]])
def test_eigenvectors_of_clustered_values(values):
    rng = np.random.default_rng(len(values))
    q = np.linalg.qr(rng.normal(size=(len(values),) * 2))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (1.5 * np.eye(len(values), dtype=np.longdouble) - q.T @ q / 2)
    v = (q * np.array(values, np.longdouble)) @ q.T
    v = (v + v.T) / 2
    value, x = eigenvectors(v)
    assert np.abs(np.sort(values)[::-1] - value).max() < 1e-17 * 10
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-17 and np.abs(v @ x - x * value).max() < 1e-17


def test_exact_products():
    rng = np.random.default_rng(1)
    for top in (10, 1 << 30, 1 << 40):
        y = rng.integers(-top, top, (50, 4))
        assert (_exact_products(y) == y.astype(object).T @ y.astype(object)).all()


# 12

def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) by definition, level by level."""
    leaf = [digest("".join(field(r[c]) for c in merkle.FIELDS)) for r in rows]
    proof, subroot = defaultdict(list), {}

    def climb(nodes):
        while len(nodes) > 1:
            above = []
            for run in (nodes[a:a + 3] for a in range(0, len(nodes), 3)):
                for k, (_, members) in enumerate(run):
                    for m in members:
                        proof[m].append(("".join(d for d, _ in run[:k]), "".join(d for d, _ in run[k + 1:])))
                above.append((digest("".join(d for d, _ in run)), [m for _, members in run for m in members]))
            nodes = above
        return nodes[0]

    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[r["source"]].append(i)
    ends = []
    for s in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        members = sorted(groups[s], key=lambda i: (rows[i]["doc_id"] is not None, rows[i]["doc_id"] or 0, leaf[i]))
        ends.append(climb([(leaf[i], [i]) for i in members]))
        subroot.update(dict.fromkeys(members, ends[-1][0]))
    root = climb(ends)[0]
    out = []
    for i, r in enumerate(rows):
        text = r["text"]
        if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
            text = text.replace("\n", "")
        now = digest("".join(field(text if c == "text" else r[c]) for c in merkle.FIELDS))
        for a, b in proof[i]:
            now = digest(a + now + b)
        out.append((r["doc_id"], leaf[i], subroot[i], root, digest("".join(a + b for a, b in proof[i])), now, now == root))
    return sorted(out, key=repr)


def manifest_rows(df, **options):
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n")))
    found = merkle.manifest(df, tampered, **options)
    return sorted(map(tuple, found.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof_text(F.col("path")), 256),
                                          "folded_root", "verified").collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"depth": 1, "chunk_rows": 30}, {"depth": 2, "chunk_rows": 1}])
def test_manifest_by_definition(spark, options):
    rng = random.Random(5)
    rows = []
    for i in range(150):
        source = rng.choice([None, "", "hot", "hot", "hot", "é", "z", f"s{i}"])
        rows.append({"doc_id": rng.choice([None, i, i, 7]), "source": source, "lang": rng.choice([None, "en", ""]), "n_chars": rng.choice([None, i]),
                     "text": rng.choice([None, "", "a\nb", "ü\n", long_text(50, i)])})
    rows += [dict(rows[3])] * 20  # repeated rows
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, source string, lang string, n_chars long, text string")
    df = df.withColumns({c: F.lit("clash") for c in ("group", "place", "digest", "id", "block", "rows", "levels", "end", "path", "tie", "name")})
    assert manifest_rows(df, **options) == plain_manifest(rows)


def test_manifest_of_one_row_and_none(spark):
    one = spark.createDataFrame([(None, None, None, None, None)], "doc_id long, source string, lang string, n_chars long, text string")
    leaf = digest("-----")
    assert manifest_rows(one) == [(None, leaf, leaf, leaf, digest(""), leaf, True)]
    assert manifest_rows(one.limit(0)) == []


# 13

def library_ids(texts):
    library = Tokenizer.from_file(queries.word_tokenizer())
    return [library.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def check_pieces(pieces, rows, window, with_ids=True):
    """Each id in one piece, sequences without gaps. Gives the share of padding."""
    want = sorted(((i, tuple(ids)) for (i, _), ids in zip(rows, library_ids(t for _, t in rows))), key=repr)
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
    padding = total = 0
    for s in sequences.values():
        s.sort(key=lambda p: p.offset)
        at = 0
        for p in s:
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= window
        total += at
        padding += 0 if at & (at - 1) == 0 else window - at
    # Pieces of a document follow each other.
    found, parts = [], []
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        if p.start == 0:
            parts = []
        assert p.start == len(parts)
        parts += p.ids
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) and len(p.ids) == p.length
        if len(parts) == p.doc_tokens:
            found.append((p.doc_id, tuple(parts)))
    assert sorted(found, key=repr) == want
    return padding / max(1, total)


@pytest.mark.parametrize("options", [{}, {"window": 64, "stretch": 500}, {"window": 16, "stretch": 1}])
def test_pieces_make_up_documents(spark, options):
    table = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    rows = [(r.doc_id, r.text) for r in table.collect()]
    pieces = packing.pack(table, queries.word_tokenizer(), with_ids=True, **options).collect()
    padding = check_pieces(pieces, rows, options.get("window", 4096))
    assert padding < 0.02 or options  # penalties are meant for wide windows


def test_pieces_of_odd_documents(spark):
    rows = [*ODD, (20, "It's. KKLVIN ẖ H̱x İstanbul don't! a.b,c <|endoftext|>x y"), (21, "x" * 30_000), (22, ". " * 9_000), (23, "\n \n")]
    odd = docs(spark, rows)
    for options in ({}, {"window": 32, "stretch": 100, "hard_step": 5}):
        check_pieces(packing.pack(odd, queries.word_tokenizer(), with_ids=True, **options).collect(), rows, options.get("window", 4096))
    assert packing.pack(odd.limit(0), queries.word_tokenizer()).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_cuts_cost_least(seed):
    rng = random.Random(seed)
    window = 16
    at = np.cumsum([0] + [rng.randint(1, window if seed % 2 else 5) for _ in range(rng.randint(1, 40))])
    penalty = np.array([0] + [rng.choice([0, 1, 4, 9]) for _ in at[1:]])
    best = [0] + [None] * (len(at) - 1)
    pay = lambda size: 0 if size & (size - 1) == 0 else window - size
    for j in range(1, len(at)):
        best[j] = min(best[i] + pay(int(at[j] - at[i])) for i in range(j) if at[j] - at[i] <= window) + penalty[j]
    cuts = packing.best_cuts(at, penalty, window, last=True)
    assert cuts[-1] == at[-1]
    cost = sum(pay(b - a) for a, b in zip([0, *cuts], cuts)) + sum(int(penalty[np.searchsorted(at, c)]) for c in cuts)
    assert cost == best[-1]
