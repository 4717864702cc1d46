"""The dedup operators against brute force: exact, lines, substrings, near copies."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from weir.llm import components, jaccard, line_dedup, sharing, suffix_array, suffix_dedup
from weir.llm.exact_dedup import DigestIndex, dedup_in_batches
from weir.llm.scratch import Scratch

from .helpers import awkward, collected, frame

ROWS = awkward()
order = lambda i: (i is not None, i or 0)  # noqa: E731  a null id comes first


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/index"


def test_exact_dedup(spark, path):
    norm = lambda t: re.sub(r"[ \t-\r]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[norm(t)].append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    wanted = sorted(((i, keep[norm(t)], len(groups[norm(t)]), i == keep[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in ROWS), key=repr)
    found = DigestIndex(spark, path, 4).dedup(frame(spark, ROWS))
    assert collected(found, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == wanted


def test_exact_dedup_of_later_batches(spark, path):
    index = DigestIndex(spark, path, 4)
    first, second = frame(spark, [(5, "a"), (6, "b")]), frame(spark, [(1, "a"), (2, "c"), (3, "c")])
    assert all(r.kept for r in index.dedup(first).collect())
    index.close()
    again = DigestIndex(spark, path, 4)  # opened from its files
    assert collected(again.dedup(second), "doc_id", "keep_id", "kept") == [(1, 5, False), (2, 2, True), (3, 2, False)]
    assert again.read().count() == 3
    assert DigestIndex(spark, path + "-none", 4).dedup(first.where("false")).count() == 0


def test_digest_index_keeps_its_buckets(spark, path):
    texts = [(i, f"text {i}") for i in range(40)]
    first = DigestIndex(spark, path, 8)
    assert all(r.kept for r in first.dedup(frame(spark, texts)).collect())
    again = DigestIndex(spark, path, 4)  # asked for otherwise
    assert again.buckets == 8 and not any(r.kept for r in again.dedup(frame(spark, [(i + 100, t) for i, t in texts])).collect())
    wider = again.compacted(path + "-wider", 16)
    assert wider.buckets == 16 and sorted(r.keep_id for r in wider.read().collect()) == list(range(40))
    assert {r.keep_id for r in wider.dedup(frame(spark, [(500, "text 7"), (501, "new")])).collect()} == {7, 501}


def test_digest_index_after_a_cut_off_append_and_a_second_writer(spark, path):
    """A batch that is run again, with some of its digests in the index, some twice, gives the same rows."""
    rows = [(5, "a"), (3, "a"), (6, "b"), (7, "c")]
    wanted = sorted((i, 3 if t == "a" else i, 2 if t == "a" else 1, i != 5) for i, t in rows)
    index = DigestIndex(spark, path, 4)
    assert collected(index.dedup(frame(spark, rows)), "doc_id", "keep_id", "group_size", "kept") == wanted
    index._append(index.read().where("keep_id < 7"))
    assert collected(index.dedup(frame(spark, rows)), "doc_id", "keep_id", "group_size", "kept") == wanted
    index._append(index.read().selectExpr("digest", "keep_id + 100 AS keep_id"))  # another writer, later ids
    assert collected(DigestIndex(spark, path).dedup(frame(spark, rows)), "doc_id", "keep_id", "group_size", "kept") == wanted


def test_exact_dedup_in_batches(spark, path):
    rows = sorted((r for r in ROWS if r[0] is not None), key=lambda r: r[0]) + [r for r in ROWS if r[0] is None]
    whole = collected(DigestIndex(spark, path, 4).dedup(frame(spark, rows)), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    for cuts in ([0, 41, len(rows)], [0, 0, 33, 44, len(rows)]):
        batches = [frame(spark, rows).where("false") if a == b else frame(spark, rows[a:b]) for a, b in zip(cuts, cuts[1:])]
        index = DigestIndex(spark, f"{path}-{len(cuts)}", 4)
        assert collected(dedup_in_batches(index, batches), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == whole


def test_exact_dedup_is_native(spark, path):
    plan = DigestIndex(spark, path, 4).dedup(frame(spark, ROWS))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def brute_lines(rows, window):
    units = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        at = [k for k, x in enumerate(lines) if x.strip(" \t\r\f\v")]
        units[(i, t)] = lines, at, [lines[k].strip(" \t\r\f\v") for k in at]
    first = {}
    for (i, t), (_, _, u) in units.items():
        for s in range(len(u) - window + 1):
            place = (*order(i), t, s)
            key = tuple(u[s : s + window])
            first[key] = min(first.get(key, place), place)
    out = []
    for i, t in rows:
        lines, at, u = units[(i, t)]
        gone = {s + k for s in range(len(u) - window + 1) if first[tuple(u[s : s + window])] != (*order(i), t, s) for k in range(window)}
        drop = {at[k] for k in gone}
        out.append((i, len(u), "" if gone and len(gone) == len(u) else "\n".join(x for k, x in enumerate(lines) if k not in drop)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [1, 2, 3])
def test_line_dedup(spark, window):
    rng = np.random.default_rng(window)
    lines = [f"line {k}" for k in range(9)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(lines, int(rng.integers(0, 12))))) for i in range(40)] + [(98, None), (99, ""), (None, "line 1\nline 2\nline 3")]
    rows += [rows[3], (7, "line 4\n line 5\t\nline 6")]
    rows = [r for r in rows if r[0] != 7] + [(7, "line 4\n line 5\t\nline 6")]
    found = line_dedup.dedup(frame(spark, rows), window)
    assert collected(found, "doc_id", "line_count", "line_kept") == brute_lines(rows, window)


def test_line_dedup_runs_and_columns(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\nb\nc\nd\ny"), (3, "b\nc")]
    found = line_dedup.dedup(frame(spark, rows), 2)
    assert found.columns[:3] == ["doc_id", "text", "lang"] and found.columns.count("line_kept") == 1
    assert {r.doc_id: [tuple(x) for x in r.line_runs] for r in found.collect()} == {1: [], 2: [(1, 4)], 3: [(0, 2)]}
    assert line_dedup.dedup(frame(spark, rows).where("false")).count() == 0


@pytest.mark.parametrize("window", [1, 2, 3])
def test_line_dedup_of_long_lines_between_other_neighbours(spark, window):
    """With long_words, a long line goes from later places whatever stands beside it; a shorter one only in a run."""
    rng = np.random.default_rng(window)
    lines = [f"line {k}" for k in range(40)] + ["", " p q r s t u\t", "v  w x y z"]
    rows = [(i, "\n".join(rng.choice(lines, int(rng.integers(0, 12))))) for i in range(40)] + [(90, "p q r s t u"), (91, None), (None, "new\np q r s t u\nneighbours")]
    seen, place = {}, lambda i, t, k: (*order(i), t, k)
    for i, t in rows:
        for k, u in enumerate(x.strip() for x in (t or "").split("\n") if x.strip()):
            if len(u.split()) > 4:
                seen[u] = min(seen.get(u, place(i, t, k)), place(i, t, k))
    wanted = []
    without = {(r.doc_id, r.text): r for r in line_dedup.dedup(frame(spark, rows), window).collect()}
    for i, t in rows:
        r = without[(i, t)]
        gone = {k for x in r.line_runs for k in range(x.start, x.end)}
        found, at = (t or "").split("\n"), -1
        drop = set()
        for n, x in enumerate(found):
            if x.strip():
                at += 1
                if at in gone or (x.strip() in seen and seen[x.strip()] != place(i, t, at)):
                    drop.add(n)
        wanted.append((i, "" if drop and len(drop) == at + 1 else "\n".join(x for n, x in enumerate(found) if n not in drop)))
    found = line_dedup.dedup(frame(spark, rows), window, long_words=4)
    assert collected(found, "doc_id", "line_kept") == sorted(wanted, key=repr)
    if window > 1:
        assert collected(found, "doc_id", "line_kept") != collected(line_dedup.dedup(frame(spark, rows), window), "doc_id", "line_kept")


def test_selected_places_cover_every_window():
    rng = np.random.default_rng(1)
    for _ in range(50):
        found = [bytes([x]) for x in rng.integers(0, 5, 30)]
        chosen = line_dedup.selected(found, 4)
        assert all(any(s <= c < s + 4 for c in chosen) for s in range(27))


def brute_bytes(rows, length):
    texts = sorted({(order(i), t or "", i) for i, t in rows}, key=lambda x: (x[0], x[1]))
    seen, gone = set(), {}
    for _, t, i in texts:
        b = t.encode()
        hit = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                hit[s : s + length] = True
            seen.add(w)
        gone[(i, t)] = hit
    out = []
    for i, t in rows:
        b, hit = (t or "").encode(), gone[(i, t or "")]
        left = np.frombuffer(b, np.uint8)[~hit].tobytes()
        out.append((i, len(b), int(hit.sum()), int((np.diff(hit.astype(int), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def byte_rows():
    # Rows that share an id with other texts have an order of their own, which the brute force does not know.
    return [r for r in ROWS if r[0] not in (61, None)] + [(None, "no id here " * 14)]


@pytest.mark.parametrize("hot", [2000, 1])
def test_suffix_dedup(spark, hot):
    """hot: with 1, every anchor of several classes goes window by window; else all go through suffix arrays."""
    found = suffix_dedup.dedup(frame(spark, byte_rows()), 30, 12, shard_bytes=4000, most_classes=hot)
    rows = [(r.doc_id, r.n_bytes, sum(x.end - x.start for x in r.removed), len(r.removed), r.kept_sha256) for r in found.collect()]
    assert sorted(rows, key=repr) == brute_bytes(byte_rows(), 30)


def test_suffix_dedup_of_random_texts(spark):
    rng = np.random.default_rng(5)
    parts = ["".join(rng.choice(list("ab"), 25)) for _ in range(8)]
    rows = [(i, "".join(rng.choice(parts, int(rng.integers(0, 9))))) for i in range(60)]
    found = suffix_dedup.dedup(frame(spark, rows, False), 20, 8, shard_bytes=500, kept_bytes=True).collect()
    got = [(r.doc_id, r.n_bytes, sum(x.end - x.start for x in r.removed), len(r.removed), r.kept_sha256) for r in found]
    assert sorted(got, key=repr) == brute_bytes(rows, 20)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in found)
    assert suffix_dedup.dedup(frame(spark, rows).where("false")).count() == 0


def test_anchors_lie_evenly_in_buckets():
    from .helpers import prose

    found = suffix_dedup.Anchors(100, 40).hashes(np.frombuffer(prose(np.random.default_rng(0), 40_000).encode(), np.uint8))
    share = np.bincount(np.searchsorted(sharing.bounds_of(50), np.unique(found), "right"), minlength=50) / len(np.unique(found))
    assert len(found) > 4000 and share.max() < 0.04


@pytest.mark.parametrize("letters", [1, 2, 3, 26])
def test_suffix_arrays(letters):
    rng = np.random.default_rng(letters)
    for n in (0, 1, 2, 3, 7, 20, 130):
        for _ in range(8):
            text = rng.integers(97, 97 + letters, n).astype(np.uint8)
            b, array = text.tobytes(), suffix_array.suffix_array(text)
            assert array.tolist() == sorted(range(n), key=lambda i: b[i:])
            common = suffix_array.common_prefixes(text, array)
            for i, j in zip(array, array[1:]):
                k = 0
                while k < min(n - i, n - j) and b[i + k] == b[j + k]:
                    k += 1
                assert common[j] == k


@pytest.mark.parametrize("alphabet", [1, 2, 5, 300, 100_000])
def test_suffix_arrays_of_names(alphabet):
    """Large alphabets, in which each name stands once or twice, and small ones, which take several recursions."""
    rng = np.random.default_rng(alphabet)
    for n in (1, 2, 3, 8, 40, 400):
        for _ in range(6):
            text = rng.integers(0, alphabet, n)
            if n > 100:
                text[200:] = text[: n - 200]
            assert suffix_array.sorted_names(text, alphabet).tolist() == sorted(range(n), key=lambda i: text[i:].tolist())


def test_suffix_arrays_compare_bytes_where_hashes_collide(monkeypatch):
    """With hashes that are all equal, arrays are still right."""
    from weir.llm import bytesops

    monkeypatch.setattr(bytesops, "span", lambda sums, a, b: np.zeros(len(a), np.uint64))
    rng = np.random.default_rng(1)
    for _ in range(20):
        text = rng.integers(97, 100, 150).astype(np.uint8)
        assert suffix_array.suffix_array(text).tolist() == sorted(range(150), key=lambda i: text.tobytes()[i:])


def brute_links(rows, size, percent):
    sets = []
    for _, t in rows:
        low = "".join(c.lower() if c.isascii() else c for c in t or "")
        w = re.findall(r"[^ \t-\r]+", low)
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((i, len(sets[k]), least.get(root(k))) for k, (i, _) in enumerate(rows)), key=repr)


def test_jaccard_components(spark):
    found = jaccard.components_of(frame(spark, ROWS))
    assert collected(found, "doc_id", "n_shingles", "component_id") == brute_links(ROWS, 5, 75)
    assert jaccard.components_of(frame(spark, ROWS).where("false")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_finds_every_link_near_the_threshold(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(6):
        base = [f"v{x}" for x in rng.integers(0, 400, 60)]
        for _ in range(12):
            edited = list(base)
            for at in rng.integers(0, 60, int(rng.integers(0, 5))):
                edited[at] = f"e{rng.integers(0, 9)}"
            rows.append((len(rows), " ".join(edited[: int(rng.integers(45, 61))])))
    rng.shuffle(rows)
    rows = [(int(i), t) for i, t in rows]
    assert collected(jaccard.components_of(frame(spark, rows, False)), "doc_id", "n_shingles", "component_id") == brute_links(rows, 5, 75)


def test_jaccard_of_slots(spark):
    """Texts of three slots with seven fillings each: all share much, and link only where two slots are equal."""
    rng = np.random.default_rng(9)
    slots = [[" ".join(f"s{k}x{f}y{w}" for w in range(14 + 2 * k)) for f in range(7)] for k in range(3)]
    common = " ".join(f"c{w}" for w in range(70))
    rows = [(int(i), " ".join([common, *(slots[k][int(f)] for k, f in enumerate(rng.integers(0, 7, 3)))])) for i in rng.permutation(120)]
    assert collected(jaccard.components_of(frame(spark, rows, False)), "doc_id", "n_shingles", "component_id") == brute_links(rows, 5, 75)


@pytest.mark.parametrize("partitions", ["1", "3", "200"])
def test_links_do_not_depend_on_partitions(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        some = [r for r in ROWS if len(r[1] or "") < 5000]
        found = jaccard.signatures(frame(spark, some, False), 5, 75).select("doc_id", "n", "digest", "alone", "prefix", "shared", "sketch").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    once = {}
    for r in found:
        once.setdefault((r.doc_id, bytes(r.digest)), set()).add((r.n, r.alone, r.prefix and bytes(r.prefix), r.shared and bytes(r.shared), r.sketch))
    SIGNED.append(once)
    assert all(x == SIGNED[0] for x in SIGNED)


SIGNED = []


def test_suffix_filter_never_drops_a_link():
    rng = np.random.default_rng(0)
    edges = np.array([i << 60 for i in range(1, 16)], np.uint64)
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 40, dtype=np.uint64) * np.uint64(2)
        a, b = (np.unique(rng.choice(pool, 30)) for _ in range(2))
        n1, n2 = len(a) + int(rng.integers(0, 4)), len(b) + int(rng.integers(0, 4))
        both = len(np.intersect1d(a, b))
        assert jaccard.linked(n1, n2, a, b, 75, edges) == (100 * both >= 75 * (n1 + n2 - both))


def test_parities_are_a_lower_bound():
    rng = np.random.default_rng(3)
    for size in (0, 1, 5, 60, 3000):
        a, b = (np.unique(rng.integers(0, 1 << 63, size + k, dtype=np.uint64) * np.uint64(2)) for k in range(2))
        b = np.union1d(a[::2], b)
        differ = sum(int(x).bit_count() for x in (jaccard.parities(a) ^ jaccard.parities(b)).view(np.uint64))
        assert differ <= len(np.setxor1d(a, b))
        assert not (jaccard.parities(a) ^ jaccard.parities(a[::-1])).any()
    one, none = jaccard.parities(np.array([7 << 32], np.uint64)), jaccard.parities(np.zeros(0, np.uint64))
    assert sum(int(x).bit_count() for x in (one ^ none).view(np.uint64)) == 1


def test_jaccard_pairs_of_slots(spark, monkeypatch):
    """Texts of four slots of which none link: no more pairs are verified than there are postings."""
    texts = [" ".join(f"s{s}f{f}w{w}" for s, f in enumerate(fills) for w in range(20)) for fills in itertools.product(range(6), repeat=4)]
    rows, seen, save = list(enumerate(texts)), {}, jaccard.Scratch.save

    def counted(self, df, name):
        made = save(self, df, name)
        seen[name] = made.count() if name in ("postings", "pairs", "rest") else None
        return made

    monkeypatch.setattr(jaccard.Scratch, "save", counted)
    found = jaccard.components_of(frame(spark, rows, False)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == [(i, 76, i) for i in range(len(rows))]
    assert seen["pairs"] + seen["rest"] <= seen["postings"]


def test_hashes_travel_whole():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 5000):
        for top in (20, 50, 64):
            some = np.unique(rng.integers(0, 1 << top, n, dtype=np.uint64) if top < 64 else rng.integers(0, (1 << 64) - 1, n, dtype=np.uint64, endpoint=True))
            assert (sharing.unpack(memoryview(sharing.pack(some)), len(some)) == some).all()
            for buckets in (1, 3, 1000):
                bounds = sharing.bounds_of(buckets)
                assert len(bounds) == buckets - 1 and (np.searchsorted(bounds, some, "right") == [(int(h >> np.uint64(32)) * buckets) >> 32 for h in some]).all()


def test_a_common_hash_is_one_entry_for_each_block():
    """A bucket hears of a hash once from a block, however often the block has it."""
    found = np.array([7, 5, 7, 7, 9 << 60, 7], np.uint64)
    sent = sharing._sent(3, b"head", found, np.arange(6, dtype="<u2"), sharing.bounds_of(4)).to_pylist()
    assert [(r["bucket"], r["kind"], r["n"], r["start"]) for r in sent] == [(3, 1, 4, 6), (0, 0, 2, 0), (2, 0, 1, 2)]
    table = [(block, r["n"], r["start"], memoryview(r["payload"])) for block in (3, 4) for r in sent if r["bucket"] == 0 and not r["kind"]]
    bits = lambda p, n: np.unpackbits(np.frombuffer(p, np.uint8, 1), count=n).tolist()
    assert [(b, bits(p, n)) for b, _, n, _, p in sharing._counted(table, False)] == [(3, [1, 1]), (4, [1, 1])]
    assert [(b, bits(p, n)) for b, _, n, _, p in sharing._counted(table[:1], True)] == [(3, [0, 1])]


def test_shared_hashes(spark):
    rng = np.random.default_rng(8)
    rows = [(i, i % 2, " ".join(map(str, rng.integers(0, 400, int(rng.integers(0, 12)))))) for i in range(60)]
    numbers = lambda data: np.array([int(x) for x in data.tobytes().split()], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    times = Counter(x for _, _, t in rows for x in t.split())
    found = {(r.a, r.b): r.bits for r in sharing.shared(spark.createDataFrame(rows, "a long, b long, text string"), numbers, 10).collect()}
    for a, b, t in rows:
        wanted = [times[x] > 1 for x in t.split()]
        assert (a, b) in found if any(wanted) else (a, b) not in found
        if any(wanted):
            assert np.unpackbits(np.frombuffer(found[a, b], np.uint8), count=len(wanted)).astype(bool).tolist() == wanted


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102), (200, 200)] + [(300, 301 + k) for k in range(20)]
    found = components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"), "c").collect()
    assert Counter(r.root for r in found).most_common() == [(0, 41), (300, 21), (100, 3)]
    assert components.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test"), "c").count() == 0
