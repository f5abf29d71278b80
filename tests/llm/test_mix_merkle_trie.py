"""Source mixing, the Merkle manifest and the prefix trie against brute-force versions, with nulls, ties, repeated rows,
empty tables, very long texts, hot groups and clashing columns."""

import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from larkspur.llm import merkle, mixing, queries, trie

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
MORE = DOCS + ", pos long, n string, sid string, size string, key string"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


# -- 11


def _docs(spark, seed=1, n=900):
    r = random.Random(seed)
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(r.choice([0, 1, 3, 20, 60]))), "en", r.choice(["hot"] * 3 + ["b", "C", "é", None, "tiny" if r.random() < 0.05 else "b"]), 1) for i in range(n)]
    rows += [(5000, "same old\ttext\n" * 3, "en", "hot", 1)] * 300 + [(None, None, None, None, None)] * 5 + [(None, "lone words here", None, None, None)] * 2
    rows += [(6000, "x " * 30_000, "en", "b", 1), (6001, "only", None, "one", 1), (6002, "", None, "none", 1), (6003, None, None, "none", 1)]
    return spark.createDataFrame([(*x, 9, "n", "s", "z", "k") for x in rows], MORE)


def _targets(sizes):
    """Sharing and resharing as it is told."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    rest, free, out = sum(sizes.values()), set(names), {}
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 3 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 3 * sizes[s]
        rest -= sum(out[s] for s in over)
        free -= over
    return out


def test_permutations_are_bijections(spark):
    for n in (1, 2, 3, 7, 64, 1000):
        got = [r.p for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(5)).alias("p")).collect()]
        assert sorted(got) == list(range(n)) and (n < 64 or got != sorted(got))


def test_targets(spark):
    r = random.Random(2)
    for sizes in ({f"s{k}": r.choice([0, 1, 5, 100, 10_000]) for k in range(30)} | {None: 40}, {"a": 0, "b": 0}, {"a": 7}, {}, {"z": 10**12, "𝒳": 3, "ﬀ": 3}):
        got = {x.source: x.target for x in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
        assert got == pytest.approx(_targets(sizes)) and len(got) == len(sizes)


def test_mix(spark):
    docs = _docs(spark)
    rows = docs.collect()
    sizes = defaultdict(int)
    for x in rows:
        sizes[x.source] += len((x.text or "").split())
    got = mixing.mix_shares(docs, block=16)
    first = sorted(map(str, got.collect()))
    assert first == sorted(map(str, mixing.mix_shares(docs.repartition(7), block=16).collect()))  # no part is played by how rows lie
    want, taken, source = _targets(sizes), defaultdict(int), {(x.doc_id, len((x.text or "").split())): x.source for x in rows}
    assert Counter((x.doc_id, x.size) for x in got.collect()) == Counter((x.doc_id, len((x.text or "").split())) for x in rows)
    for x in got.collect():
        s = source[x.doc_id, x.size]
        assert 0 <= x.taken <= 3 * x.size and x.source_size == sizes[s] and x.target == pytest.approx(want[s])
        taken[s] += x.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(1, 0.01 * want[s]), s


def test_mixed_blocks_hold_what_is_taken(spark):
    docs = _docs(spark, seed=3, n=300)
    mix = mixing.Mix(docs, block=16, shard=64)
    blocks = mix.mixed(docs).collect()
    assert sorted((x.shard, x.slot) for x in blocks) == [(k // 64, k % 64) for k in range(len(blocks))]
    assert {(x.shard, x.source): x.slots for x in mix.counts().collect()} == Counter((x.shard, x.source) for x in blocks)
    used = Counter((x.source, x.block) for x in blocks)
    for s in {x.source for x in blocks}:  # a source's blocks are used equally often, or once more
        assert max(n for (a, _), n in used.items() if a == s) - min(n for (a, _), n in used.items() if a == s) <= 1
    text, words = {(x.source, x.block): x.text for x in blocks}, Counter()
    for key, t in text.items():
        for w in t.split():
            words[w] += used[key]
    got = {(x.doc_id, x.size): x.taken for x in mix.taken().where("doc_id < 300").collect()}
    for x in docs.where("doc_id < 300").collect():
        own = (x.text or "").split()
        assert got[x.doc_id, len(own)] == sum(words[w] for w in own)
    assert all(len(t.split()) <= 16 for t in text.values())


def test_shards_are_mixed(spark):
    """A shard's counts lie about the whole mix's shares, as a multinomial draw's do."""
    docs = spark.createDataFrame([(i, "w " * 50, "s" + str(i % 3)) for i in range(3000)], "doc_id long, text string, source string")
    mix = mixing.Mix(docs, block=4)
    share = {x.source: x.target / 150_000 for x in mix.sources.collect()}
    off = [((x.slots - 1024 * share[x.source]) ** 2) / (1024 * share[x.source] * (1 - share[x.source])) for x in mix.counts().where("shard < 36").collect()]
    assert len(off) == 108 and 0.5 < sum(off) / len(off) < 1.6


# -- 12


def _tree(leaves):
    """(root, a path of sibling lists and places for each leaf) by levels."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for p, i in zip(paths, at, strict=True):
            p.append((level[i - i % 3 : i], level[i + 1 : i - i % 3 + 3]))
        level, at = [H(*level[k : k + 3]) for k in range(0, len(level), 3)], [i // 3 for i in at]
    return level[0], paths


def _leaf(x, text):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (x.doc_id, x.source, x.lang, x.n_chars, text)])


def _manifest(rows):
    by, out = defaultdict(list), []
    for x in rows:
        by[x.source].append(x)
    groups = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in groups:
        by[s].sort(key=lambda x: (x.doc_id is not None, x.doc_id or 0, _leaf(x, x.text)))
        trees[s] = _tree([_leaf(x, x.text) for x in by[s]])
    root, tops = _tree([trees[s][0] for s in groups])
    for s, top in zip(groups, tops, strict=True):
        for x, path in zip(by[s], trees[s][1], strict=True):
            odd = x.text is not None and x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 2 == 0
            folded = _leaf(x, x.text.replace("\n", "") if odd else x.text)
            for left, right in path + top:
                folded = H(*left, folded, *right)
            out.append((x.doc_id, _leaf(x, x.text), trees[s][0], root, H(*[d for left, right in path + top for d in left + right]), folded, folded == root))
    return out


def test_traversal():
    for n in (*range(1, 40), 81, 82, 243, 244, 500, 729):
        leaves = [H(str(k)) for k in range(n)]
        root, paths = _tree(leaves)
        levels = merkle.height(n)
        assert list(merkle.traverse(leaves, levels)) == [[("".join(a), "".join(b)) for a, b in p] for p in paths]
        assert merkle.block_root(leaves, levels) == root
        # An unfinished block of a larger tree climbs through all its levels.
        for leaf, path in zip(leaves, merkle.traverse(leaves, merkle.BLOCK), strict=True):
            assert merkle.fold(leaf, path) == merkle.block_root(leaves, merkle.BLOCK)


def test_traversal_holds_few_digests():
    tree = merkle.Subtree(4, 6)
    for k in range(729):
        tree.add(str(k))
        assert sum(map(len, tree.runs[:4])) <= 8 and sum(map(len, tree.nodes)) <= 12


def test_manifest(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["a\nb", "", "c\n" * 5000, "é🙂\n", "plain"]), r.choice(["en", None]), "hot", r.choice([1, None])) for i in range(1600)]
    rows += [(i, "t\n", "en", f"s{k}", k) for k in range(12) for i in range(2 * k, 5 * k + 1)] + [(7, "x", None, "", 1), (8, None, "en", None, 2), (None, None, None, None, None)]
    rows += [(40, "\n", "en", "ties", 1)] * 5 + [(40, "y", "en", "ties", 1), (None, "y\n", "en", "ties", 1), (None, None, "en", "ties", 1)]
    docs = spark.createDataFrame([(*x, 3, "n", "s", "z", "k") for x in rows], MORE)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    got = merkle.manifest(docs.repartition(9), fields, shown={"text": tampered}, with_path=True)
    assert sorted(tuple(x)[:-1] for x in got.where("doc_id IS NOT NULL").collect()) == sorted(x for x in _manifest(docs.collect()) if x[0] is not None)
    assert {tuple(x)[1:-1] for x in got.where("doc_id IS NULL").collect()} == {x[1:] for x in _manifest(docs.collect()) if x[0] is None}
    for x in got.limit(50).collect():
        assert merkle.fold(x.leaf, [tuple(p.split("|")) for p in x.path]) == x.root
    assert merkle.manifest(docs.limit(0), fields).isEmpty()
    lone = merkle.manifest(docs.where("source IS NULL AND doc_id = 8"), fields).first()
    assert lone.leaf == lone.subroot == lone.root == lone.folded_root and lone.verified and lone.proof_sha256 == H("")


# -- 13

TURNS = "conv_id long, turn long, role string, text string"


def _rebuilt(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100, [])[: h[c]] + v[h[c] :] for c, v in own.items()}


def _trie(convs):
    members = defaultdict(list)
    for c, seq in sorted(convs.items()):
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    ends = {k: sha256(",".join(str(c) for c in m if len(convs[c]) == len(k)).encode()).hexdigest() for k, m in members.items()}
    return sorted((m[0], len(k), members[k[:-1]][0] if k else -1, len(m), children[k], leaves[k], saved[k], ends[k]) for k, m in members.items())


def _nodes(df):
    return sorted(tuple(-1 if v is None else v for v in x) for x in df.collect())


@pytest.fixture
def many_ranges(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def _talk(seed, n):
    r, rows = random.Random(seed), []
    for c in range(n):
        length = r.choice([0, 1, 2, 3, 5, 8, 30 if r.random() < 0.05 else 4])
        hot = r.random() < 0.35
        for t in range(length if not hot else 6):
            said = f"same {t}" if hot else r.choice(["a", "bb", "é🙂", None, "x" * 50])
            rows.append((c, None if t == 0 and r.random() < 0.1 else t, r.choice(["user", None]) if not hot else "user", said))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_trie_over_many_ranges(spark, many_ranges, seed):
    rows = _talk(seed, 700)
    convs = trie.sequences(spark.createDataFrame([(*x, 1) for x in rows], TURNS + ", seq int"))
    assert _nodes(trie.nodes(trie.rebuilt(convs))) == _trie(_rebuilt(rows))


def test_trie_of_chains_and_copies(spark, many_ranges):
    """Each conversation a prefix of the next, and a third of all alike: every node is on the spine of some range."""
    rows = [(c, t, "u", f"{t}") for c in range(60) for t in range(c)] + [(c, t, "u", f"{t}") for c in range(1000, 1030) for t in range(20)]
    own = defaultdict(list)
    for c, _, role, text in rows:
        own[c].append((role, text))
    convs = trie.sequences(spark.createDataFrame(rows, TURNS))
    assert _nodes(trie.nodes(convs)) == _trie(own)
    turnless = spark.createDataFrame([(3, b""), (1, b"")], "conv_id long, seq binary")
    assert _nodes(trie.nodes(turnless)) == [(1, 0, -1, 2, 0, 1, 0, sha256(b"1,3").hexdigest())]


def test_trie_edges(spark):
    empty = spark.createDataFrame([], TURNS)
    assert trie.nodes(trie.sequences(empty)).isEmpty()
    rows = [(None, 0, "user", "lost"), (5, 1, None, None), (5, None, "", ""), (5, 2, "us", "er"), (6, 0, None, ""), (6, 1, "", None), (6, 2, "u", "ser"), (205, 0, "a", "t" * 100_000)]
    assert _nodes(trie.nodes(trie.rebuilt(trie.sequences(spark.createDataFrame(rows, TURNS))))) == _trie(_rebuilt(rows))


def test_queries_against_plain(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert sorted(tuple(x) for x in queries.op12_merkle_manifest(spark, sf_dir).collect()) == sorted(_manifest(docs))
    rows = [tuple(x) for x in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert _nodes(queries.op13_prefix_trie(spark, sf_dir)) == _trie(_rebuilt(rows))
    sizes, source = Counter(), {}
    for x in docs:
        sizes[x.source] += len(x.text.split())
        source[x.doc_id] = x.source
    want, taken = _targets(sizes), Counter()
    for x in queries.op11_source_mixing(spark, sf_dir).collect():
        taken[source[x.doc_id]] += x.taken
        assert x.target == pytest.approx(want[source[x.doc_id]])
    assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] for s in sizes)
