import itertools
import random

from siltstone.llm import encodings, leakage, main_body, near_duplicates, packing, repeated_lines, residue

WORDS = [f"w{i}" for i in range(400)]
WEIGHTS: dict = {}


def make(rng, n=80):
    return rng.choices(WORDS, k=n)


def html(words):
    return "<h1>t</h1><p>" + " ".join(words)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(7)
    rows, sets = [], {}
    for _ in range(12):
        base = make(rng)
        for _ in range(rng.randrange(1, 6)):
            words = list(base)
            for _ in range(rng.randrange(0, 7)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            rows.append((len(rows) + 1, "https://h.example/", html(words)))
    rows += [(900, "https://h.example/", rows[0][2]), (901, None, rows[0][2]), (902, "u", None), (903, "u", ""), (904, "u", html(make(rng, 20)))]
    for rid, _, page in rows:
        words = ["t", *(page or "").split("<p>")[-1].split()]
        if len(words) >= 50:
            sets[rid] = set(zip(words, words[1:], words[2:], strict=False))
    parent = {x: x for x in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b]):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    expected = {x: find(x) for x in sets}
    results = spark.createDataFrame(rows, "result_id long, url string, html string")
    classes = near_duplicates.near_duplicate_classes(results, WEIGHTS)
    rows_of = classes.collect()
    assert {r["result_id"]: r["class_id"] for r in rows_of} == expected
    assert {r["result_id"]: r["links"] for r in rows_of} == {x: sum(x != y and len(sets[x] & sets[y]) >= 0.7 * len(sets[x] | sets[y]) for y in sets) for x in sets}
    assert near_duplicates.class_pairs(classes, 2).count() == near_duplicates.class_pairs(classes).count()
    pairs = {tuple(r) for r in near_duplicates.class_pairs(classes).collect()}
    assert pairs == {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if expected[a] == expected[b]}
    assert near_duplicates.near_duplicate_classes(results.where("false"), WEIGHTS).count() == 0


def test_cut_nodes_lose_no_pair(spark):
    rng = random.Random(8)
    base = make(rng)
    rows = []
    for n in range(30):
        words = list(base)
        words[n] = f"own{n}"
        rows.append((n, "u", html(words)))
    sets = near_duplicates.bodies(spark.createDataFrame(rows, "result_id long, url string, html string"), WEIGHTS).cache()
    whole = {tuple(sorted(r)[:2]) for r in near_duplicates.similar_sets(sets)[0].select("a", "b").collect()}
    cut = {tuple(sorted(r)[:2]) for r in near_duplicates.similar_sets(sets, node_rows=7)[0].select("a", "b").collect()}
    assert whole == cut and len(whole) == 435


def test_repeated_lines(spark):
    rows = [(n, f"https://h.example/{n}", f"<p>Same long legal line {n} here<p>own words of page {'abcdefghij'[n] * 3}<li>two words") for n in range(10)]
    rows += [(20, "HTTPS://H.example:443/0#x", rows[0][2]), (21, "https://i.example/1", rows[0][2]), (22, None, rows[0][2]), (23, "https://h.example/x", None)]
    long = " ".join(WORDS[i] * 2 for i in range(60))
    rows += [(30 + n, f"https://l.example/{n}", f"<p>{' '.join(chr(97 + ord(c) % 26) * 3 for c in long)}<p>tail {'abcde'[n] * 4} xx yy") for n in range(5)]
    found = {tuple(r) for r in repeated_lines.repeated_lines(spark.createDataFrame(rows, "result_id long, url string, html string")).collect()}
    assert found == {(n, 1) for n in range(10)} | {(20, 1)} | {(30 + n, 1) for n in range(5)}
    assert repeated_lines.repeated_lines(spark.createDataFrame([], "result_id long, url string, html string")).count() == 0


def test_packing(spark):
    rng = random.Random(2)
    sizes = [(n, rng.choice(["en", "de", None]), "s", rng.randrange(0, 300)) for n in range(400)] + [(1000, "en", "s", 1050)]
    packs = spark.createDataFrame([(1, 256, "lang"), (2, 512, "all"), (3, None, "all")], "pack_id int, capacity_tokens int, fill_within string")
    table = spark.createDataFrame(sizes, "doc_id long, lang string, source string, tokens long")
    rows = packing.pack(table, packs, part_items=50).collect()
    lang = {d: x for d, x, _, _ in sizes}
    for pack, capacity in ((1, 256), (2, 512)):
        own = [r for r in rows if r["pack_id"] == pack]
        bins, kinds = {}, {}
        for r in own:
            bins[r["container_id"]] = bins.get(r["container_id"], 0) + max(1, r["tokens"])
            kinds.setdefault(r["container_id"], set()).add(lang[r["doc_id"]])
        assert max(bins.values()) <= capacity
        assert sum(r["tokens"] for r in own) == sum(s[3] for s in sizes)
        assert {r["doc_id"] for r in own} == {s[0] for s in sizes}
        assert all(sum(r["doc_id"] == d for r in own) == max(1, -(-t // capacity)) for d, _, _, t in sizes)
        assert pack == 2 or all(len(k) == 1 for k in kinds.values())
        assert len(bins) <= 1.12 * sum(max(1, s[3]) for s in sizes) / capacity + 3
    assert packing.pack(table.where("false"), packs).count() == 0
    assert packing.pack(table, packs.where("false")).count() == 0


def test_tables_with_nulls_and_nothing(spark):
    results = spark.createDataFrame([(1, None, None, None), (2, "u", "", 200), (3, None, "<p>x", None)], "result_id long, url string, html string, status_code int")
    for rows in (results, results.where("false")):
        assert main_body.main_body(rows, main_body.fit_on(rows)).count() <= 1
        assert residue.residue_pages(rows, residue.fit_models_on(rows)).count() <= 1
    documents = spark.createDataFrame([(1, None), (2, ""), (3, "é" * 100_000)], "doc_id long, text string")
    items = spark.createDataFrame([(1, None), (2, " ".join(WORDS[:20]))], "item_id long, passage string")
    for rows in (documents, documents.where("false")):
        assert encodings.restore(rows, encodings.fit_models_on(rows)).count() == 0
        assert leakage.leaked_items(rows, items).count() == 0
        assert leakage.leaked_items(rows, items.where("false")).count() == 0


def letters(n):
    return "".join(chr(97 + int(d)) for d in f"{n:03d}")


def test_a_line_that_is_the_end_of_a_longer_one(spark):
    words = next(w for w in ([f"{letters(n)}x{letters(k)}" for k in range(24)] for n in range(999)) if len(repeated_lines.chunk_ends(w)) == 2 and len(repeated_lines.chunk_ends(w[repeated_lines.chunk_ends(w)[0] :])) == 1)
    tail = words[repeated_lines.chunk_ends(words)[0] :]
    rows = [(n, f"https://h.example/{n}", f"<p>{' '.join(words)}") for n in range(6)] + [(n, f"https://h.example/{n}", f"<p>{' '.join(tail)}") for n in (6, 7)]
    results = spark.createDataFrame(rows, "result_id long, url string, html string")
    assert {tuple(r) for r in repeated_lines.repeated_lines(results).collect()} == {(n, 1) for n in range(6)}


def test_lines_are_cut_from_the_text(spark):
    rows = [(n, f"https://h.example/{n}", f"<p>Same legal line {n} here<p>own {letters(n)} {letters(n * 7)} words") for n in range(9)] + [(9, "u", None), (10, "https://h.example/x", "text only")]
    results = spark.createDataFrame(rows, "result_id long, url string, html string")
    got = {r["result_id"]: (r["removed"], r["text"]) for r in repeated_lines.without_repeated_lines(results, repeated_lines.repeated_lines(results)).collect()}
    assert got == {n: (1, f"own {letters(n)} {letters(n * 7)} words") for n in range(9)} | {10: (0, "")}
