import pyarrow as pa
import pytest

from scriptorium.llm import noise

BLOCK = "block_id bigint, scan_id bigint, page_number int, block_pos int, type string, text string, items array<string>, src string"
CELL = "cell_id bigint, block_id bigint, text string, kind string"
COMMON = "the foreman checked the storage plan and the workshop counted the damaged crates for the management near the long-term fence "


def frames(spark, blocks, cells=()):
    filler = [(1000 + i, 1000 + i, 1, 0, "paragraph", COMMON * 3 + ".", None, "x") for i in range(20)]
    return spark.createDataFrame([*filler, *blocks], BLOCK), spark.createDataFrame(list(cells), CELL)


def found(spark, blocks, cells=()):
    return {(r.src, r.row_id, r.item_pos, r.kind) for r in noise.find(*frames(spark, blocks, cells)).collect()}


def test_hyphen_and_misread(spark):
    blocks = [
        (1, 1, 1, 0, "paragraph", "the fore-\nman checked the long-\nterm plan (M21-\n251).", ["the stor\xad\nage plan", "the plan", None], "x"),
        (2, 1, 1, 1, "paragraph", "the forernan c0unted the damaged crates.", None, "x"),
        (3, 1, 1, 2, "paragraph", "the foreman counted the long-\nterm plan.", None, "x"),
    ]
    cells = [(7, 3, "the damagcd\ncrates", "k"), (8, 3, "36.B85", "k"), (9, 3, "KL-841", "k"), (10, 3, None, "k"), (11, 3, "", "k"), (12, 3, "A4", "k")]
    got = found(spark, blocks, cells)
    assert got == {("block", 1, -1, "hyphen"), ("item", 1, 0, "hyphen"), ("block", 2, -1, "misread"), ("cell", 7, -1, "misread"), ("cell", 8, -1, "misread")}


def test_heads_page_numbers_and_carry(spark):
    head = "Stock Sheet B20 the crates"
    blocks = [
        (1, 1, 1, 0, "heading", "Title", None, "x"), (2, 1, 1, 1, "paragraph", "the foreman checked the dam-\nPage 1", None, "x"),
        (3, 1, 2, 0, "paragraph", f"{head}\naged crates.", None, "x"), (4, 1, 2, 1, "paragraph", "- ii -", None, "x"),
        (5, 1, 3, 0, "paragraph", head.upper() + "   3", None, "x"), (6, 1, 3, 1, "paragraph", "the workshop counted.", None, "x"), (7, None, None, None, "paragraph", "2", None, "x"),
    ]
    assert found(spark, blocks) == {
        ("block", 2, -1, "page_no"), ("block", 2, -1, "carry"), ("block", 2, -1, "hyphen"), ("block", 3, -1, "header"),
        ("block", 4, -1, "page_no"), ("block", 5, -1, "header"), ("block", 5, -1, "page_no"),
    }
    text = {r.row_id: r.text for r in noise.repair(*frames(spark, blocks)).where("src = 'block'").collect()}
    assert text[2] == "the foreman checked the damaged crates." and text[3] is None and text[4] == ""


def test_empty(spark):
    b, c = frames(spark, [])
    assert noise.find(b.limit(0), c).count() == 0


@pytest.mark.parametrize(("text", "cell", "right"), [("36.B85", True, "36.885"), ("l2.5 kg", True, "12.5 kg"), ("EUR 1O", True, "EUR 10"), ("S69", True, "569"), ("about 12,4S0.70 were left", False, "about 12,450.70 were left"), ("total 1O.5O EUR", False, "total 10.50 EUR")])
def test_figures_found_are_put_right(text, cell, right):
    lex = noise.Lexicon([("about", 50, "about"), ("total", 50, "total"), ("left", 9, "left")])
    assert noise.noise_in_short(text, lex, cell)[1] and noise.repair_text(text, lex, None, [], False, cell) == right


@pytest.mark.parametrize("text", ["see B14 and R37-934", "lot S2/l5", "a.B@c.d", "12.50 kg", "Z46944090"])
def test_codes_are_no_figures(text):
    lex = noise.Lexicon([("see", 50, "see")])
    assert not noise.noise_in_short(text, lex, False)[1] and noise.right_figures(text, False) == text


def test_every_misreading_found_is_repaired(spark):
    d = "/root/testdata/sf0.001"
    b, c = spark.read.parquet(f"{d}/block.parquet"), spark.read.parquet(f"{d}/cell.parquet")
    hit = {(r.src, r.row_id, r.item_pos) for r in noise.find(b, c).where("kind = 'misread'").collect()}
    texts = {("cell", r.cell_id, -1): r.text for r in c.collect()} | {("block", r.block_id, -1): r.text for r in b.collect()}
    texts |= {("item", r.block_id, i): x for r in b.collect() for i, x in enumerate(r["items"] or [])}
    after = {(r.src, r.row_id, r.item_pos): r.text for r in noise.repair(b, c).collect()}
    assert hit and not [k for k in hit if after[k] == texts[k]]


def test_accents_stay_when_a_word_is_repaired():
    lex = noise.Lexicon([("prufte", 200, "prüfte")])
    assert noise.repair_text("Er prufie, er Prüftc.", lex, None, [], False) == "Er prufie, er Prüfte."


def test_rare_words_not_dominated_keep_their_counts(spark, monkeypatch):
    """A word below MIN_SHARE whose twin is less than DOMINANCE times as frequent is no misreading, whatever the corpus's size."""
    monkeypatch.setattr(noise, "MIN_SHARE", 0.02)
    text = "modern " * 300 + "modem " * 20 + "the plan " * 400 + "modcrn "
    b = spark.createDataFrame([(1, 1, 1, 0, "paragraph", text, None, "x")], BLOCK)
    rows = noise.lexicon(noise.texts_of(b, spark.createDataFrame([], CELL)))
    lex = noise.Lexicon(rows)
    assert lex.counts["modem"] == 20 and lex.reading("modem") is None and lex.reading("modcrn") == "modern"


def test_words_of_a_batch_are_read_once(monkeypatch):
    """The cost of p4_found: equal words of a batch are looked at once, not in every text."""
    lex = noise.Lexicon([(w, 500, w) for w in set(COMMON.split())])
    read = []

    class Counting:
        def findall(self, text):
            read.append(len(text))
            return word.findall(text)

    word = noise._WORD
    monkeypatch.setattr(noise, "_WORD", Counting())
    n = 1000
    ints = pa.array([1] * n, pa.int32())
    cols = {"src": pa.array(["block"] * n), "row_id": pa.array(range(n), pa.int64()), "text": pa.array([COMMON * 3] * n), "items": pa.nulls(n, pa.list_(pa.string())), "scan_id": pa.array([1] * n, pa.int64()), "page_number": ints, "block_pos": ints, "type": pa.array(["paragraph"] * n)}
    noise.annotate_batch(pa.RecordBatch.from_pydict(cols), lex)
    assert sum(read) <= len(COMMON)


def test_texts_of_a_batch_as_one_by_one():
    lex = noise.Lexicon([(w, 500, w) for w in ("foreman", "checked", "storage", "crates", "l'avion", "plan")])
    texts = ["x", "", " ", "the foreman", "the\u00a0forernan\u00a0checked", "crat\x1ces", "storagc\tplan", "\ncrates\n", "l'avi0n", "storage-p1an", "(craies)", "fore-\nrnan", "stor¬ \nage", "about 12,4S0.70", "12.S", "B14 l2.5", "craίes", "ſtorage", "S69", "plan\u2028forernan", "crates|crates", "\U0001d7d9 storagc"]

    def one(t):
        flat = noise.joined(t, None, lex)
        said = {lex.verdicts[w] for w in noise._WORD.findall(flat)}
        return (noise.HYPHEN if len(flat) < len(t) else 0) | (noise.MISREAD if 1 in said or 2 in said and noise._FIGURE_IN_TEXT.search(flat) else 0)

    want = [one(t) for t in texts]
    assert sum(map(bool, want)) > 8 and noise.noise_of(pa.array(texts).slice(1), lex).tolist() == want[1:] and not len(noise.noise_of(pa.array([], pa.string()), lex))
    assert noise.noise_of(pa.array(texts), lex, None, True).tolist() == [w | (noise.MISREAD if noise.figure_cell(t) else 0) for w, t in zip(want, texts)]


def test_page_lines_begin_and_end_as_their_filter_says():
    lines = [f"{a}{w}{b}{n}{c}" for a in ("", "- ", "[", "| ") for w in ("", "Page ", "Стр. ", "ſ ", "ı") for b in ("", "~") for n in ("12", "l2", "xii", "IO", "٣", "3 of 12", "3 из ıv") for c in ("", " -", ")", ".")]
    hit = [x for x in lines if noise._PAGE_LINE.fullmatch(x)]
    assert len(hit) > 100 and all(noise._STARTS[x[:1]] and noise._ENDS[x[-1:]] for x in hit)


def test_items_and_their_positions():
    lex = noise.Lexicon([("crates", 500, "crates")])
    items = pa.array([None, ["x"], [], ["crates", None, "cratcs", ""], ["cratcs"]], pa.list_(pa.string())).slice(1)
    none = pa.nulls(4, pa.int32())
    b = pa.RecordBatch.from_pydict({"row_id": pa.array([5, 6, 7, 8], pa.int64()), "text": pa.array([""] * 4), "items": items, "scan_id": none, "page_number": none, "block_pos": none, "type": pa.array(["list"] * 4)})
    notes = noise.annotate_batch(b, lex).to_pylist()
    assert [(r["row_id"], r["item_pos"], r["bits"]) for r in notes] == [(7, 2, noise.MISREAD), (8, 0, noise.MISREAD)]


def test_head_with_nothing_but_its_number_below(spark):
    """A first block of head and page number has no line after its head; the carry goes there without a cut word."""
    head = "Stock Sheet of the crates"
    blocks = [(1, 1, 1, 0, "paragraph", "the foreman checked the dam-", None, "x"), (2, 1, 2, 0, "paragraph", f"{head}\n2", None, "x"), (3, 1, 3, 0, "paragraph", f"{head}\n3", None, "x")]
    got = found(spark, blocks)
    assert {("block", 2, -1, "header"), ("block", 2, -1, "page_no"), ("block", 1, -1, "carry"), ("block", 3, -1, "header")} <= got
    assert ("block", 1, -1, "hyphen") not in got


@pytest.mark.parametrize("one_line", [True, False])
def test_carry_after_a_head_whose_other_pages_are_lost(spark, one_line):
    head, rest = "Stock Sheet of the crates", "aged crates."
    blocks = []
    for scan in range(1, 4):
        blocks += [(10 * scan + p, scan, p, 0, "heading", head, None, "x") for p in (2, 3)]
    blocks.append((51, 5, 1, 0, "paragraph", "the foreman checked the dam-", None, "x"))
    blocks += [(52, 5, 2, 0, "heading", head, None, "x"), (53, 5, 2, 1, "paragraph", rest, None, "x")] if one_line else [(52, 5, 2, 0, "paragraph", f"{head}\n{rest}", None, "x")]
    got = {r for r in found(spark, blocks) if r[1] > 50 and r[1] < 1000}
    assert got == {("block", 51, -1, "carry"), ("block", 51, -1, "hyphen"), ("block", 52, -1, "header")}
    text = {r.row_id: r.text for r in noise.repair(*frames(spark, blocks)).where("src = 'block'").collect()}
    assert text[51] == "the foreman checked the damaged crates."
