from scriptorium.plans import core

LONG = "the foreman checked the storage plan and counted "


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_whole_lines_of_every_script(spark, tmp_path):
    texts = {1: [LONG + "the crates", LONG + "a fence", LONG + "the grates"], 2: ["Größe der Kiste", "Grösse der Kiste", "x"], 3: ["склад закрыт", "склад открыт"]}
    rows = [(i, i, 1, 0, "paragraph", "\n".join(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "block_id bigint, scan_id bigint, page_number int, block_pos int, type string, text string").write.parquet(str(tmp_path / "block.parquet"))
    got = {r.truth_id: r.distance for r in core.QUERIES["best_line_match"](spark, str(tmp_path)).collect()}
    assert got == {i: min(distance(t[0], x) for x in t[1:]) for i, t in texts.items()}


def test_bins_and_bounds_lose_nothing(spark):
    import random

    from scriptorium.operators import quality

    rng = random.Random(1)
    say = lambda: "".join(rng.choices("abcé", k=rng.choice([0, 1, 3, 9, 20, 40])))
    truth = [(rng.randrange(3), i, say()) for i in range(60)] + [(9, 99, "alone"), (0, 100, None)]
    lines = [(rng.randrange(3), say()) for _ in range(80)] + [(1, None)]
    lines += lines[:10]
    got = quality.best_line_match(spark.createDataFrame(truth, "k int, truth_id int, truth string"), spark.createDataFrame(lines, "k int, line string"), ["k"])
    want = {(k, i): min(distance(t, x) for g, x in lines if g == k and x is not None) for k, i, t in truth if k < 3 and t is not None}
    assert {(r.k, r.truth_id): r.distance for r in got.collect()} == want
