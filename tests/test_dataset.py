from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from themeloom import constants as K
from themeloom.operators import dataset, similarity
from themeloom.operators.dataset import Taxonomy
from themeloom.plans import build
from themeloom.sources import cards as card_files
from themeloom.sources import json_arrays, provenance


def card_rows(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                                 "pos long, category string, term string, definition string")


def test_mapping_precedence(spark):
    rows = [("kuantum", "Kübit", "x"), ("kuantum", "dalga", "x"), ("anatomi", "kemik", "x"),
            ("yemek", "çorba", "x"), ("kuslar", "martı", "x"), ("futbol", "qubit", "x"),
            ("kuantum", "KUANTUM BİLGİSAYAR", "x")]
    got = dataset.map_labels(card_rows(spark, rows), Taxonomy()).orderBy("pos").collect()
    assert [(r.general, r.subtopic, r.excluded) for r in got[:6]] == [
        ("Teknoloji", "Kuantum Bilgisayarlar", False), ("Fizik", "Kuantum Mekaniği", False),
        (None, None, True), ("Diğer", None, False), ("Biyoloji", "Zooloji", False),
        ("Spor", "Futbol", False)]


def test_taxonomy_is_consistent(spark):
    t = Taxonomy()
    assert len(t.categories) == 41 and len(t.excluded) == 31
    assert not set(t.categories) & set(t.excluded)
    assert t.hierarchy(spark).count() == 38
    assert dataset.taxonomy_seeds(spark, t).count() == 114
    df = spark.createDataFrame([("Fizik", "Optik"), ("Kimya", "Optik")],
                               "general string, subtopic string")
    assert [r.general for r in dataset.valid_hierarchy(df, t).collect()] == ["Fizik"]


def test_cleaning(spark):
    cards = card_rows(spark, [
        ("genetik", "alel", "aynı yerin seçeneği"), ("genetik", "alel", "aynı yerin seçeneği"),
        ("genetik", "x", "aynı metin"), ("futbol", "x", "aynı metin"), ("genetik", "boş", ""),
        ("anatomi", "kemik", "sert doku")])
    records = dataset.to_records(cards, Taxonomy(), "s", ["pos"])
    kept = dataset.dedup_conflicts(records, "pos").collect()
    assert [(r.pos, r.text, r.general, r.group) for r in kept] == [
        (0, "alel aynı yerin seçeneği", "Biyoloji", "alel")]
    counts = dataset.cleaning_counts(cards, Taxonomy(), "pos").first().asDict()
    assert counts == {"raw_rows": 6, "excluded_ambiguous_rows": 1,
                      "duplicates_or_conflicts_removed": 3, "rows_after_cleaning": 1}


def make_cards(spark):
    rows = []
    for c, n in [("optik", 40), ("futbol", 40), *[(f"diger{i}", 10) for i in range(8)]]:
        rows += [(c, f"{c} terim{chr(97 + i % 26)}{chr(97 + i // 26)}", f"{c} tanım {chr(97 + i % 26)}"
                  f"{chr(97 + i // 26)} sözcük") for i in range(n)]
    return card_rows(spark, rows)


def test_build_has_no_leaks(spark):
    external = spark.createDataFrame(
        [("bio", "Bir iki üç dört beş altı yedi. Kısa cümle. Bir iki üç dört beş altı yedi.")],
        "source string, text string")
    splits = build.build_splits(make_cards(spark), Taxonomy(), "pos", external=external,
                                targets={"bio": ("Biyoloji", None)}).cache()
    sizes = {r.split: r.n for r in splits.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert sizes["external"] == 1 and sizes["train"] > sizes["test"] > 0 and sizes["val"] > 0
    unseen = splits.filter(F.col("split").startswith("ood")).select("category").distinct().collect()
    seen = splits.filter(F.col("split").isin("train", "val", "test"))
    assert len(unseen) == round(8 * .35)
    assert seen.filter(F.col("category").isin([r.category for r in unseen])).count() == 0
    leaks = dataset.leakage_counts(splits).collect()
    assert all(r.shared_groups == 0 and r.shared_texts == 0 for r in leaks)
    total = {r.split: r.n for r in dataset.split_distribution(splits).filter(
        F.col("general").isNull()).collect()}
    assert total == sizes
    report = build.split_report(splits)
    assert report["near_copies_external"].first().rate == 0.0


def test_near_copies_against_brute_force(spark):
    import math
    base = "güneş enerjisi panelleri ile elektrik üretimi ve depolama yöntemleri"
    refs = [base, base, "futbol maçında hakem kararı", "kuantum dolanıklık deneyi " + base,
            "tamamen farklı bir cümle"]
    asked = [base, base + "i", "futbol maçında hakem kararları", "hiç ilgisi olmayan", "",
             "kuantum dolanıklık deneyleri " + base]
    ref = spark.createDataFrame([(t,) for t in refs], "text string")
    query = spark.createDataFrame(list(enumerate(asked)), "id int, text string")

    def grams(t):
        out = {}
        for w in t.split():
            p = f" {w} "
            for n in (3, 4, 5):
                for i in range(len(p) - n + 1):
                    out[p[i:i + n]] = out.get(p[i:i + n], 0) + 1
        return out
    ref_grams = [grams(t) for t in refs]
    df = {}
    for g in ref_grams:
        for t in g:
            df[t] = df.get(t, 0) + 1

    def vector(g):
        x = {t: (1 + math.log(c)) * (math.log((1 + len(refs)) / (1 + df[t])) + 1)
             for t, c in g.items() if t in df}
        n = math.sqrt(sum(v * v for v in x.values()))
        return {t: v / n for t, v in x.items()} if n else {}
    vectors = [vector(g) for g in ref_grams]
    for threshold in (0.5, 0.8, 0.9, 0.97):
        expected = {i: any(sum(v * r.get(t, 0) for t, v in vector(grams(q)).items()) >= threshold
                           - 1e-9 for r in vectors) for i, q in enumerate(asked)}
        postings = 1 if threshold in (0.8, 0.97) else similarity.POSTINGS  # all terms cut up, none
        got = {r.id: r.near_copy for r in similarity.near_copies(
            ref, query, threshold, postings=postings).collect()}
        assert got == expected


def test_candidates_hold_every_close_pair(spark):
    """Random unit vectors over few terms, so that all terms are common."""
    import numpy as np
    draw = np.random.default_rng(3)
    rows = []
    for i in range(120):
        terms = np.sort(draw.choice(30, size=draw.integers(1, 12), replace=False))
        w = draw.random(len(terms)) + 0.05
        rows.append((f"k{i}", terms.tolist(), (w / np.sqrt((w * w).sum())).tolist()))
        moved = w * (1 + 0.3 * draw.random(len(w)))
        rows.append((f"m{i}", terms.tolist(), (moved / np.sqrt((moved * moved).sum())).tolist()))
    vectors = spark.createDataFrame(rows, "key string, terms array<long>, w array<double>")
    maps = {k: dict(zip(t, w, strict=True)) for k, t, w in rows}
    for threshold in (0.6, 0.9):
        close = {(a, b) for a, x in maps.items() for b, y in maps.items()
                 if sum(v * y.get(t, 0.0) for t, v in x.items()) >= threshold}
        found = [sorted(similarity.candidates(vectors, vectors, threshold, postings).collect())
                 for postings in (7, 10_000)]
        assert found[0] == found[1]  # pieces change nothing
        assert len(set(found[0])) == len(found[0]) and close <= {(r.qid, r.rid) for r in found[0]}


def test_near_copies_write_little(spark):
    """Nothing is written for each text and n-gram: tables stay within a few times the texts."""
    import numpy as np
    from pathlib import Path

    from themeloom.session import recorded
    draw = np.random.default_rng(5)
    words = ["".join(draw.choice(list("abcdefghijklmnop"), draw.integers(3, 9))) for _ in range(3000)]
    refs = [" ".join(draw.choice(words, 250)) for _ in range(300)]
    asked = [*(f"{t} {words[i]}" for i, t in enumerate(refs[:60])),
             *(" ".join(draw.choice(words, 250)) for _ in range(60))]
    with recorded() as tables:
        got = {r.id: r.near_copy for r in similarity.near_copies(
            spark.createDataFrame([(t,) for t in refs], "text string"),
            spark.createDataFrame(list(enumerate(asked)), "id int, text string")).collect()}
    assert got == {i: i < 60 for i in range(120)}
    written = sum(f.stat().st_size for t in tables
                  for f in Path(t.removeprefix("file:")).rglob("*.parquet"))
    assert written < 5 * sum(map(len, refs + asked))


def test_hashed_grams_are_the_counted_ones():
    from themeloom.functions import chargrams
    texts = ["ab cde  fghij", "", "x", "güneş güneş enerji", "ab cde  fghij"]
    counted = [{} for _ in texts]
    for row, gram, n in chargrams.count_grams(texts, 3, 5):
        for r, g, k in zip(row.tolist(), gram.tolist(), n.tolist(), strict=True):
            counted[r][g] = k
    hashed = list(chargrams.hashed_grams(texts, 3, 5))
    assert [sorted(n.tolist()) for _, n in hashed] == [sorted(c.values()) for c in counted]
    everything = {g for c in counted for g in c}
    assert len({h for hs, _ in hashed for h in hs.tolist()}) == len(everything)
    assert hashed[0][0].tolist() == hashed[4][0].tolist()


def write_json(folder, name, value):
    (folder / name).write_text(value if isinstance(value, str) else json.dumps(
        value, ensure_ascii=False), encoding="utf-8")


def test_card_files(spark, tmp_path):
    write_json(tmp_path, "genetik.json", [
        {"kategori": "genetik ", "kelime": " gen", "aciklama": "birim", "zorluk": 2}])
    write_json(tmp_path, "a.json", {"not": "a list"})
    rows = card_files.read_cards(spark, str(tmp_path)).collect()
    assert [(r.category, r.term, r.definition) for r in rows] == [("genetik", "gen", "birim")]
    write_json(tmp_path, "b.json", [{"kategori": "x", "kelime": "y"}])
    with pytest.raises(card_files.DatasetError, match="aciklama"):
        card_files.read_cards(spark, str(tmp_path))
    write_json(tmp_path, "b.json", "{broken")
    with pytest.raises(card_files.DatasetError, match="corrupt"):
        card_files.read_cards(spark, str(tmp_path))


def test_split_card_files(spark, tmp_path):
    """One file read in byte ranges of 500 bytes gives what a parser of the whole file gives."""
    names = K.CARD_KEYS
    odd = ['brace } in { text', 'quote \\" } "', 'back\\\\slash\\', 'a, ] [ b', '}', 'ünï ] ☕ }{',
           'line\nbreak', ""]
    cards = [dict(zip(names, (f"k{i}", odd[i % 8] * (i % 5), odd[(i + 3) % 8]), strict=True),
                  more={"inner": [{"x": odd[i % 8]}, {}]} if i % 3 else []) for i in range(60)]
    (tmp_path / "one.json").write_text(json.dumps(cards, ensure_ascii=False, indent=1), "utf-8")
    (tmp_path / "two.json").write_text(json.dumps(cards[:7]), "utf-8")
    (tmp_path / "none.json").write_text(" [ ] ", "utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        rows = json_arrays.read_arrays(spark, str(tmp_path)).collect()
        ranges = spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert ranges > 10 and {r.state for r in rows} == {"object"}
    got = {n: [json.loads(r.value) for r in sorted(rows, key=lambda r: r.position)
               if r.path.endswith(n)] for n in ("one.json", "two.json", "none.json")}
    assert got == {"one.json": cards, "two.json": cards[:7], "none.json": []}


def test_card_problems(spark, tmp_path):
    whole = json.dumps([dict.fromkeys(K.CARD_KEYS, "x")] * 3)
    for name, value in {
            "good": whole, "object": '{"not": {"a": "list"}}', "number": "3", "empty": "",
            "blank": " ", "cut": whole[:-1], "cut_inside": whole[:-9], "broken": "{broken",
            "comma": whole[:-1] + ",]", "no_comma": whole.replace("}, {", "} {"),
            "twice": whole + whole, "scalar": whole[:-1] + ", 3]", "scalars": "[1, 2]",
            "nested": f"[{whole}]", "first": "[3, " + whole[1:],
            "lacks": whole.replace(K.CARD_KEYS[2], "other", 1)}.items():
        write_json(tmp_path, f"{name}.json", value)
    got = {r.path.rsplit("/", 1)[1][:-5]: r for r in
           card_files.card_problems(spark, str(tmp_path)).collect()}
    assert {n for n, r in got.items() if r.problem == "corrupt"} == {
        "empty", "blank", "cut", "cut_inside", "broken", "comma", "no_comma", "twice"}
    assert {n: r.lacking for n, r in got.items() if r.problem == "fields"} == {
        "scalar": list(K.CARD_KEYS), "scalars": list(K.CARD_KEYS), "nested": list(K.CARD_KEYS),
        "first": list(K.CARD_KEYS), "lacks": [K.CARD_KEYS[2]]}
    assert got["lacks"].position == 0


def test_paragraphs_and_splits(spark, tmp_path):
    raw = tmp_path / "raw" / "deep"
    raw.mkdir(parents=True)
    write_json(raw, "q.json", {"data": [{"paragraphs": [{"context": "A."}, {"context": "B."}]}]})
    got = card_files.read_paragraphs(spark, str(tmp_path / "raw"), "bio").collect()
    assert [(r.source, r.text) for r in got] == [("bio", "A."), ("bio", "B.")]
    records = spark.createDataFrame(
        [("t", "Fizik", None, "c", "t", "g", "s", "val"), ("u", "Spor", "F", "c", "t", "g", "s",
                                                            "train")],
        ", ".join(f"`{c}` string" for c in (*dataset.RECORD_COLUMNS, "split")))
    out = str(tmp_path / "out")
    card_files.write_splits(records, out)
    row = card_files.read_split(spark, out, "val").first()
    assert (row.text, row.general, row.subtopic) == ("t", "Fizik", None)
    with pytest.raises(card_files.DatasetError):
        card_files.read_split(spark, out, "test").count()


def test_manifest(spark, tmp_path):
    folder = tmp_path / "files"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.txt").write_bytes(b"abc")
    (folder / "sub" / "b.txt").write_bytes(b"xyz")
    digests = provenance.file_digests(spark, str(folder))
    assert {r.path: (r.bytes, r.sha256) for r in digests.collect()} == {
        "a.txt": (3, hashlib.sha256(b"abc").hexdigest()),
        "sub/b.txt": (3, hashlib.sha256(b"xyz").hexdigest())}
    manifest = spark.createDataFrame([("a.txt", "0"), ("c.txt", "0")], "path string, sha256 string")
    assert {r.path: r.state for r in provenance.check_manifest(digests, manifest).collect()} == {
        "a.txt": "mismatch", "c.txt": "missing", "sub/b.txt": "extra"}
    records = spark.createDataFrame([("train",), ("train",), ("val",)], "split string")
    assert tuple(provenance.dataset_info(records, "0123456789abcdef").first()) == (
        "0123456789ab", 2, 1, 0)
    assert K.EXPECTED_CARDS == 37_278


def test_card_files_hold_a_hundred_cards(spark):
    """The query's files: so few that there are about a hundred cards for each."""
    from pathlib import Path

    from __spark_entry__ import queries
    from themeloom.session import run_folder
    folder = Path(run_folder(spark).removeprefix("file:"))

    def files():
        return set(folder.rglob("part-*.txt"))
    before = files()
    sf = "/root/testdata/sf0.01"
    assert queries()["card_files_read"](spark, sf).count() == 1000
    categories = spark.read.parquet(f"{sf}/documents.parquet").select("lang", "source").distinct()
    assert 0 < len(files() - before) <= categories.count()
