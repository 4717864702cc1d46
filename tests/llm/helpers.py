import numpy as np

WORDS = "the of and to in is it on as for with was by at be that from are this or".split() + [f"w{i}" for i in range(300)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n))


def awkward(seed=0):
    """(doc_id, text) with nulls, empties, repeats, ties, copies, near copies, shared passages and one very long text."""
    rng = np.random.default_rng(seed)
    base, passage = prose(rng, 120), prose(rng, 60)
    changed = base.split()
    changed[60] = "changed"
    rows = [(i, prose(rng, int(rng.integers(1, 90)))) for i in range(30)]
    rows += [(40, base), (41, base), (42, base.upper()), (43, " ".join(changed)), (44, base.replace(" ", "  \t")), (45, passage + "\n" + prose(rng, 50)), (46, prose(rng, 40) + "\n" + passage)]
    rows += [(50, None), (51, ""), (52, " \n\t "), (53, None), (54, "one two"), (55, "one two"), (56, "é ñ 日本語 😀 one\x00two")]
    rows += [(60, "same text for one id " * 3), (60, "same text for one id " * 3), (61, "first " + prose(rng, 20)), (61, "second " + prose(rng, 20)), (None, "no id here " * 4), (None, "nor here " * 5)]
    rows += [(70, "of " * 4000), (71, "x" * 30000), (72, prose(rng, 20000))]
    return rows


def frame(spark, rows, clashing=True):
    """documents with other columns, some of them named as operators' own."""
    if not clashing:
        return spark.createDataFrame(rows, "doc_id long, text string")
    names = ("lang", "source", "n_chars", "digest", "score", "n", "node", "key", "count", "start", "bits", "predicted", "line_kept", "bench_hits", "kept")
    full = [(i, t, "en", "src0", len(t or ""), *(["z"] * (len(names) - 3))) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names[3:]))


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
