"""The manifest, the id files and the repair of conversations against plain Python, over real rows and rows of every odd kind."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from hashlib import md5, sha256
from itertools import product
from random import Random

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from stampline.llm import conversations, merkle, queries, tokens
from stampline.llm.oracles import ORACLE_SQL

FILE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (None, None, None, None, None), (None, "words", "en", None, 5), (None, "words", "en", None, 5), (3, "a\nb", "en", "x", 3), (3, "a\nb", "en", "x", 3), (3, "a\nc\n", "en", "x", 4), (1 << 62, "\n", None, "é", 1),
    (-5, "", "", "", 0), (7, "lone", "de", "only one", 4), (8, "ab " * 50_000, "en", "x", 150_000), *((i, f"row {i}\n", "en", "many", i) for i in range(200)),
]


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes, fanout):
    """Root, and of each node the digests beside its path with the place of its own and the size of the run."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for k, i in enumerate(at):
            r, p = runs[i // fanout], i % fanout
            paths[k].append((r[:p], r[p + 1 :]))
            at[k] = i // fanout
        nodes = [digest(*r) for r in runs]
    return nodes[0], paths


def manifest(rows, fanout=3):
    """Of rows (doc_id, source, lang, n_chars, text): what the query returns."""
    leaves = [digest(*map(field, r)) for r in rows]
    order = lambda s: (s is not None, (s or "").encode())
    sources = sorted({r[1] for r in rows}, key=order)
    members = {s: sorted((i for i, r in enumerate(rows) if r[1] == s), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaves[i])) for s in sources}
    trees = {s: tree([leaves[i] for i in members[s]], fanout) for s in sources}
    root, above = tree([trees[s][0] for s in sources], fanout) if sources else (None, [])
    for s, up in zip(sources, above, strict=True):
        for i, path in zip(members[s], trees[s][1], strict=True):
            doc_id, *rest, text = rows[i]
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            now = digest(*map(field, (doc_id, *rest, text)))
            for low, high in path + up:
                now = digest(*low, now, *high)
            yield doc_id, leaves[i], trees[s][0], root, digest(*(d for low, high in path + up for d in low + high)), now, now == root


@pytest.fixture(scope="module")
def docs(spark, data):
    base = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    clash = [F.lit(1).alias(c) for c in ("tree", "node", "nodes", "digest", "unit", "top", "siblings", "steps", "root", "all", "of", "shard", "base", "_hash", "_read", "ids", "start")]
    return base.unionByName(spark.createDataFrame(ODD, SCHEMA)).select("*", *clash).repartition(5)


def written(frame, folder, name):
    frame.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_manifest(spark, docs, tmp_path):
    got = queries.QUERIES["op11_merkle"](spark, written(docs, tmp_path, "documents"))
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    want = list(manifest(rows))
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert {True, False} == {w[-1] for w in want} and len(want) == len(rows)


@pytest.mark.parametrize(("fanout", "levels"), [(3, 1), (2, 2), (5, 1), (3, 3)])
def test_manifest_by_many_rounds(docs, fanout, levels):
    """Small superblocks, so that roots of superblocks are collapsed again and again."""
    same = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    proofs = merkle.manifest(docs.select("doc_id", "source", merkle.leaf(*same).alias("leaf"), F.lit("kept").alias("mine")), fanout, levels)
    got = proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(F.lower(F.hex("siblings")), 256).alias("proof"), "mine").collect()
    rows = [tuple(r) for r in docs.select(*same).collect()]
    rows = [(d, s, la, n, t) for d, s, la, n, t in rows]
    assert Counter(tuple(r)[:5] for r in got) == Counter(w[:5] for w in manifest(rows, fanout))
    assert {r["mine"] for r in got} == {"kept"}
    root = got[0]["root"]
    checked = merkle.verify(proofs.withColumn("leaf", F.when(F.col("doc_id") != 3, F.col("leaf")).otherwise(F.sha2(F.lit("forged"), 256))), root)
    assert {(r["doc_id"] == 3 or r["doc_id"] is None, r["verified"]) for r in checked.filter("doc_id is not null").collect()} == {(True, False), (False, True)}
    assert not merkle.verify(proofs.limit(1).withColumn("leaf", F.lit(None).cast("string")), root).first()["verified"]


def test_manifest_of_little(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, leaf string")
    assert merkle.manifest(empty).collect() == []
    one = digest("x")
    got = merkle.manifest(spark.createDataFrame([(1, None, one)], "doc_id long, source string, leaf string")).first()
    assert (got["leaf"], got["subroot"], got["root"], bytes(got["siblings"])) == (one, one, one, b"")


def encoded(rows):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(FILE)
    return [(d, [*known.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in rows]


def test_tokens(spark, docs, tmp_path):
    got = queries.QUERIES["op12_tokens"](spark, written(docs, tmp_path, "documents")).collect()
    want = encoded([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in want)
    got.sort(key=lambda r: r["start"])
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))


def test_token_files(spark, docs, tmp_path):
    """The files by numpy alone: flat ids in the order of shards, and offsets."""
    shards = tokens.write(docs, FILE, 1, f"file://{tmp_path}/ids").orderBy("shard").collect()
    want = encoded([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    flat, found = [], []
    for s in shards:
        path = s["path"].split("file:", 1)[1]
        ids = np.fromfile(path + ".bin", "<u2")
        head = np.fromfile(path + ".idx", tokens.HEAD, 1)[0]
        assert s["base"] == sum(map(len, flat)) and (head["docs"], head["ids"], head["width"]) == (s["n_docs"], len(ids), 2)
        shard = tokens.Mapped(s["path"])
        offsets = shard.offsets(0, len(shard))
        assert isinstance(shard.ids(0, 1), np.memmap) and offsets[0] == 0 and offsets[-1] == len(ids)
        found += [(d, tuple(ids[a:b].tolist())) for d, a, b in zip(shard.doc_ids(0, len(shard)), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        flat.append(ids)
    assert Counter(found) == Counter((d, tuple(i)) for d, i in want)
    assert len(shards) > 1


def test_tokens_of_little(spark, tmp_path, monkeypatch):
    empty = spark.createDataFrame([], SCHEMA)
    shards = tokens.write(empty, FILE)
    assert shards.collect() == [] and tokens.read(shards).collect() == []
    monkeypatch.setattr(tokens, "_width", lambda file, end: 4)
    frame = spark.createDataFrame([(1, None), (1, "some words"), (1, "some words"), (None, "more")], "doc_id long, text string")
    got = tokens.read(tokens.write(frame, FILE, 9)).collect()
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == Counter((d, (*i[:-1], 9)) for d, i in encoded([(1, None), (1, "some words"), (1, "some words"), (None, "more")]))


def test_units_and_batches(spark, docs, monkeypatch):
    monkeypatch.setattr(tokens, "UNIT", 7)
    shards = tokens.write(docs, FILE)
    assert Counter(r["n_ids"] for r in tokens.read(shards).collect()) == Counter(len(i) for _, i in encoded([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]))


GRAMMAR = re.compile("(s?(ua)+)?")


def cheapest(turns):
    """Cost, audit and repaired turns by trying everything: what each turn becomes, then what must be inserted between."""
    ways = []
    for role, text, must_go, truncated in turns:
        more = 3 if truncated else 0
        own = [("D", 4, None)]
        if not must_go:
            own += [("K", more, (role, text)), ("R", 3 + more, ("user", text)), ("R", 3 + more, ("assistant", text))]
        ways.append(own)
    best = None
    for chosen in product(*ways):
        # insertions in any place, as few as the grammar asks for or one pair more
        line = [(e, c, t) for e, c, t in chosen]
        partial = [(0, "", ())]
        for spot in range(len(line) + 1):
            grown = []
            for cost, audit, out in partial:
                for extra in ((), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")):
                    e, c, t = line[spot] if spot < len(line) else ("", 0, None)
                    grown.append((cost + 3 * len(extra) + c, audit + "I" * len(extra) + e, (*out, *((x, "") for x in extra), *([t] if t else []))))
            partial = [g for g in grown if re.match(r"s?(ua)*u?$", "".join(r[:1] or "?" for r, _ in g[2]))]
        for cost, audit, out in partial:
            if GRAMMAR.fullmatch("".join(r[:1] or "?" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, out
    return best


def random_turns(random, n):
    return [(random.choice(("system", "user", "user", "assistant", "assistant", "tool", "")), f"t{i}", random.random() < 0.2, random.random() < 0.2) for i in range(n)]


def test_search_tries_everything():
    random = Random(5)
    for _ in range(150):
        turns = random_turns(random, random.randrange(5))
        (cost, audit), = conversations.search(turns, 0, True).values()
        want = cheapest(turns)
        assert (cost, audit) == want[:2], turns
        assert [(r, t) for _, r, t in conversations.replay(turns, 0, audit)] == list(want[2])


@pytest.mark.parametrize("piece", [1, 2, 7])
def test_pieces_find_the_same(monkeypatch, piece):
    random = Random(piece)
    for _ in range(40):
        rows = [(i, random.choice(("system", "user", "assistant", "assistant", "other")), random.choice(("", "one.", "two", "three!", f"x{i}.", f"y{i}")), random.random() < 0.1) for i in range(random.randrange(30))]

        def run(size):
            monkeypatch.setattr(conversations, "PIECE", size)
            talk = conversations.Conversation(True)
            for row in rows:
                talk.add(*row)
            return talk.result()

        assert run(piece) == run(10_000)


def expected(rows):
    """The contract by dynamic programming over whole conversations, which the search for one must equal."""
    talks = {}
    for conv, turn, role, text in rows:
        said = lambda v: " " if v is None else str(v)
        fault = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = "user" if fault == 4 else said(role), {1: "", 2: re.sub("[.!?]", "", said(text))}.get(fault, said(text))
        talks.setdefault(conv, []).extend([(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1))
    for conv, all_ in talks.items():
        all_.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], md5(t[2].encode()).hexdigest()))
        seen, turns, faults = set(), [], Counter()
        for _, role, text in all_:
            words = text.strip(" \t\n\v\f\r")
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
            seen.add((role, text))
            faults[fault] += 1
            turns.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        ways = {0: (0, "", ())}
        step = lambda q, r: {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((q, r[:1]))
        for turn in [None, *turns]:
            grown = {} if turn else dict(ways)
            if turn:
                role, text, must_go, truncated = turn
                for q, (cost, audit, out) in ways.items():
                    more = 3 * truncated
                    options = [(q, cost + 4, audit + "D", out)]
                    if not must_go:
                        options += [(step(q, role), cost + more, audit + "K", (*out, f"{role}:{text}"))] + [(step(q, r), cost + more + 3, audit + "R", (*out, f"{r}:{text}")) for r in ("user", "assistant")]
                    for to, *way in options:
                        if to is not None and (to not in grown or tuple(way) < grown[to]):
                            grown[to] = tuple(way)
            for _ in range(3):
                for q, (cost, audit, out) in list(grown.items()):
                    for r in ("user", "assistant"):
                        way = cost + 3, audit + "I", (*out, f"{r}:")
                        if (to := step(q, r)) is not None and (to not in grown or way < grown[to]):
                            grown[to] = way
            ways = grown
        cost, audit, out = min(ways[q] for q in (0, 3) if q in ways)
        numbers = [t for t, _, _ in all_ if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(all_, all_[1:], strict=False))
        yield conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha256("\n".join(out).encode()).hexdigest()


TALKS = [
    (None, None, None, None), (None, 0, "user", "hm."), (None, 0, "user", "hm."), (9001, None, "user", "first"), (9001, 5, "assistant", "a."), (9001, 5, "assistant", "a."), (9001, 5, "assistant", "b?"),
    (9002, 3, "", "x."), (9002, 4, "System", "y!"), (9002, 90, "system", " \t\n"), (9003, 7, "user", "nbsp "), (9003, 8, "assistant", " "), (9004, 1, "assistant", "long words here. " * 70_000),
    *((9005, i, ("user", "assistant", "system", None)[i * 7 % 4], f"turn {i}" + (".", "")[i % 3 == 0]) for i in range(1200)),
]


def test_conversations(spark, data, tmp_path):
    base = spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text")
    frame = base.unionByName(spark.createDataFrame(TALKS, base.schema)).select("*", *(F.lit(1).alias(c) for c in ("present", "hash", "again", "there", "fault", "copies", "cost"))).repartition(3)
    got = queries.QUERIES["op13_conversations"](spark, written(frame, tmp_path, "conversations"))
    want = list(expected([tuple(r)[:4] for r in frame.collect()]))
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert len(want) == frame.select("conv_id").distinct().count()


def test_dropped_conversations(spark):
    frame = spark.createDataFrame([(1, 0, "user", "x."), (1, 1, "assistant", "y."), (2, 0, "user", "z.")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in conversations.repair(frame, F.col("conv_id") == 1).collect()}
    assert (got[2]["cost"], got[2]["audit"], got[2]["repaired_sha256"], got[2]["turns"]) == (0, "", sha256(b"").hexdigest(), [])
    assert [tuple(t) for t in got[1]["turns"]] == [("K", "user", "x."), ("K", "assistant", "y.")]
    assert conversations.repair(frame.limit(0)).collect() == []


def test_oracles_of_odd_rows(spark, docs, tmp_path):
    """The SQL of both on rows with nulls and ties."""
    import duckdb

    con = duckdb.connect()
    folder = written(docs.filter("length(text) < 1000 or text is null"), tmp_path, "documents")
    con.sql(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = Counter(con.sql(f"select {', '.join(names)} from ({ORACLE_SQL['op11_merkle']})").fetchall())
    assert Counter(map(tuple, queries.QUERIES["op11_merkle"](spark, folder).select(names).collect())) == want
    talks = spark.createDataFrame([t for t in TALKS if t[0] is not None and t[0] != 9004], "conv_id long, turn long, role string, text string")
    written(talks, folder, "conversations")
    con.sql(f"create view conversations as select * from '{folder}/conversations.parquet/*.parquet'")
    got = queries.QUERIES["op13_conversations"](spark, folder)
    assert Counter(map(tuple, got.collect())) == Counter(con.sql(f"select {', '.join(got.columns)} from ({ORACLE_SQL['op13_conversations']})").fetchall())
