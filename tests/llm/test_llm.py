"""Operators of the training-data subpackage against brute force, exact round trips and held-out labels, and their corner cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from factloom.llm import decontamination, fingerprints, jaccardjoin, licences, linededup, markup, pagetext, pieces, quality, sharding, trainingorder
from factloom.llm.components import components
from factloom.llm.repeats import held, places, repeat_filter
from factloom.llm.wordhash import shingle_sets, word_hashes

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, words string, label string, n int"
BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "clash", "clash", 1) for i, t in rows], SCHEMA)


def corner(spark):
    """Nulls, blanks, ties, repeated rows, a very long text, extra columns whose names operators use inside."""
    story = " ".join(f"w{k}" for k in range(40))
    return [(1, None), (2, ""), (3, "  \n\t "), (4, story), (5, story), (6, story + " end"), (7, "One"), (8, "one"), (9, story.upper()), (None, story), (None, None),
            (10, "x y z " * 30_000), (11, "A shared line of some length\nown words here"), (12, "a SHARED line of some length \nother words"),
            (13, "\tA shared line of some length\nA shared line of some length\nshort"), (14, "Größe ñandú 日本語 🙂 é"), (4, story)]


def documents(spark, folder=SMALL):
    return spark.read.parquet(f"{folder}/documents.parquet")


def bare_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]


def grams(text, width):
    w = bare_words(text)
    return {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


# fingerprints


def check_edits(rows, given):
    order = sorted(given, key=lambda r: -r[0])
    after = {a[0]: order[(k + 1) % len(order)][1] or "" for k, a in enumerate(order)}
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(given)
    for i, t in given:
        t = t or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + after[i][:half]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for column, other in (("near_edited", edited), ("near_next", after[i])):
            a, b = ({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if (w := x.lower().split()) else set() for x in (t, other))
            exact = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(got[i][column] - exact) < (0.2 if len(a | b) > 128 else 1e-9)


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_fingerprints_follow_the_next_document(spark, ranges):
    given = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    rows = fingerprints.edit_report(documents(spark), ranges=ranges).collect()
    check_edits(rows, given)


def test_fingerprint_corner_cases(spark):
    rows = fingerprints.edit_report(frame(spark, corner(spark)), ranges=4).collect()
    assert len(rows) == len(corner(spark))
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r["own"])
    assert by[4][0] == by[5][0] == by[9][0] != by[6][0] and by[2] == [[]] and by[1] == [[]] and by[7] == by[8]
    assert fingerprints.edit_report(frame(spark, [])).count() == 0
    one = fingerprints.edit_report(frame(spark, [(5, "abcd")])).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one[0]["near_next"] == 1.0
    check_edits(fingerprints.edit_report(frame(spark, [(-3, "a b"), (2**62, "c"), (0, None)])).collect(), [(-3, "a b"), (2**62, "c"), (0, None)])


def test_sketches_merge_and_estimate(spark):
    rng = random.Random(3)
    parts = [(k % 2, " ".join(str(rng.randint(0, 10**9)) for _ in range(2000))) for k in range(6)]
    df = fingerprints.fingerprinted(spark.createDataFrame(parts, "part int, text string"))
    whole = df.selectExpr("1 AS one", "sketch")
    merged = {r["part"]: r["sketch"] for r in fingerprints.merged_by(df, ["part"]).collect()}
    hashes = collections.defaultdict(set)
    full = fingerprints.fingerprinted(spark.createDataFrame(parts, "part int, text string"), k=10**6).collect()
    for r in full:
        hashes[r["part"]] |= set(r["sketch"])
    assert all(merged[p] == sorted(hashes[p])[:128] for p in (0, 1))
    total = fingerprints.merged_by(whole, ["one"]).select(fingerprints.distinct_count(fingerprints.F.col("sketch")).alias("n")).first()["n"]
    assert abs(total / 12_000 - 1) < 0.35
    share = df.where("part = 0").limit(1).crossJoin(fingerprints.merged_by(df, ["part"]).where("part = 0").select(fingerprints.F.col("sketch").alias("all")))
    assert share.select(fingerprints.containment(fingerprints.F.col("sketch"), fingerprints.F.col("all")).alias("c")).first()["c"] > 0.6


# decontamination


def test_decontamination_finds_substituted_passages_and_no_others(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((12, 20, 45, 90))] + [(8, "too short"), (9, None), (10, "")]
    swapped = lambda t, every: " ".join(word() if k % every == every - 1 else w for k, w in enumerate(t.split()))
    filler = lambda n: " ".join(word() for _ in range(n))
    docs, expected = [], set()
    for k, t in items[:4]:
        docs += [(10 * k + 1, filler(30) + " " + t + " " + filler(20)), (10 * k + 2, t.upper().replace(" ", ", ")), (10 * k + 3, filler(60))]
        expected |= {(10 * k + 1, k), (10 * k + 2, k)}
        if len(t.split()) >= 20:
            docs += [(10 * k + 4, filler(5) + " " + swapped(t, 9) + " " + filler(5)), (10 * k + 5, swapped(t, 3))]
            expected.add((10 * k + 4, k))
    middle = " ".join(items[3][1].split()[20:60])
    docs += [(99, filler(10) + " " + middle), (98, "too short"), (97, None), (96, ""), (1, docs[0][1])]
    expected.add((99, 3))
    index = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontamination.contaminated(frame(spark, docs), index).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == expected
    assert all(0.8 <= r["similarity"] <= 1 for r in found)
    one = next(r for r in found if r["doc_id"] == 11)
    assert (one["first_token"], one["last_token"]) == (30, 49)
    left = {r["doc_id"] for r in decontamination.decontaminated(frame(spark, docs), index).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in expected}
    assert decontamination.contaminated(frame(spark, []), index).count() == 0
    assert decontamination.contaminated(frame(spark, docs), index.where("item_id > 7")).count() == 0


def test_decontamination_finds_parts_of_items_and_short_items(spark):
    rng = random.Random(6)
    filler = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    items = [(1, filler(48)), (2, filler(7)), (3, filler(11)), (4, filler(60))]
    long, other = items[0][1].split(), items[3][1].split()
    changed = [w if k not in (5, 11) else "new" for k, w in enumerate(other[20:36])]
    docs = [(1, f"{filler(20)} {' '.join(long[:6])}\n{' '.join(long[35:])} {filler(20)}"), (2, f"{filler(9)} {items[1][1].title()}? {filler(9)}"), (3, items[2][1]),
            (4, f"{filler(30)} {' '.join(changed)} {filler(30)}"), (5, f"{filler(20)} {' '.join(long[10:21])} {filler(20)}"), (6, " ".join(items[1][1].split()[:6]))]
    found = decontamination.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, 1), (2, 2), (3, 3), (4, 4)}
    assert {r["doc_id"]: (r["first_token"], r["last_token"]) for r in found if r["doc_id"] < 4} == {1: (26, 38), 2: (9, 15), 3: (0, 10)}
    assert all(0.8 <= r["similarity"] <= 1 for r in found)


# sharding


def test_sharding_is_even_gapless_and_versioned(spark, tmp_path):
    for rows in ([(r["doc_id"], r["text"]) for r in documents(spark).collect()], corner(spark)):
        out = sharding.sharded(frame(spark, rows), f"{tmp_path}/{len(rows)}", shards=4).collect()
        assert collections.Counter(r["doc_id"] for r in out) == collections.Counter(i for i, _ in rows)
        loads, spots = collections.Counter(), collections.defaultdict(list)
        for r in out:
            loads[r["shard"]] += r["size"]
            spots[r["shard"]].append(r["slot"])
        assert all(sorted(v) == list(range(len(v))) for v in spots.values())
        expected = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
        assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == expected
        if len(rows) > 100:
            assert max(loads.values()) - min(loads.values()) < 0.05 * sum(loads.values()) / 4
    assert sharding.sharded(frame(spark, []), f"{tmp_path}/none").count() == 0
    first = sharding.SlotMap.loaded(spark, f"{tmp_path}/{len(rows)}", 0)
    assert first == sharding.SlotMap.even(4) and sharding.SlotMap.loaded(spark, f"{tmp_path}/{len(rows)}", 1).version == 1


def test_slot_maps_move_little_when_shards_come_or_go():
    rng = random.Random(2)
    weights = {s: rng.randint(1, 1000) for s in range(sharding.SLOTS)}
    one = sharding.SlotMap.even(16).rebalanced(weights)
    more = one.rebalanced(weights, 17)
    moved = [s for s in range(sharding.SLOTS) if one.shard[s] != more.shard[s]]
    assert sum(more.shard[s] == 16 for s in moved) > 0.8 * len(moved) and len(moved) < 0.09 * sharding.SLOTS
    fewer = more.rebalanced(weights, 16)
    load = collections.Counter()
    for s, shard in enumerate(fewer.shard):
        load[shard] += weights[s]
    assert len(load) == 16 and max(load.values()) - min(load.values()) < 1000
    assert sharding.SlotMap.even(3).rebalanced({}).shard == sharding.SlotMap.even(3).shard


# line dedup


def brute_lines(rows):
    key = lambda line: line.strip(BLANK).translate(LOWER)
    docs = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                docs[key(line)].add(-1 if i is None else i)
    out = collections.Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(docs.get(key(x), ())) < 3 or (-1 if i is None else i) == max(docs[key(x)])]
        out[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


@pytest.mark.parametrize("bits", [64, 1 << 16])
def test_line_dedup_equals_brute_force(spark, bits):
    rng = random.Random(7)
    pool = ["  Some LINE that is long enough ", "some line that is long enough", "short", "x" * 20, "ÄÖÜ ist keine kurze Zeile", "", "another line, also long enough\t"]
    many = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 6)))) for k in range(60)]
    for rows in (many, corner(spark)):
        out = linededup.deduplicated(frame(spark, rows), bits=bits).collect()
        got = collections.Counter((r["doc_id"], r["__dedup"]["n_lines"], r["__dedup"]["n_dropped"], r["__dedup"]["text"]) for r in out)
        assert got == brute_lines(rows)
    assert linededup.deduplicated(frame(spark, []), bits=bits).count() == 0


def test_repeat_filter_misses_no_repeat(spark):
    rng = random.Random(1)
    values = [rng.getrandbits(63) for _ in range(500)]
    rows = [(v,) for v in values] + [(v,) for v in values[:100]]
    df = spark.createDataFrame(rows, "v bigint").repartition(5)
    again = repeat_filter(df, lambda b: ([np.array([v], np.uint64)] [0] for v in b.column(0).to_pylist()), 1 << 14)
    hit = held(again, places(np.array(values, np.uint64), 1 << 14))
    assert hit[:100].all() and hit[100:].mean() < 0.1


# training order


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation_is_one_to_one_and_keyed(size):
    there = trainingorder.permuted(np.arange(size), size)
    assert sorted(there) == list(range(size)) and (trainingorder.permuted(there, size, back=True) == np.arange(size)).all()
    if size > 100:
        assert (trainingorder.permuted(np.arange(size), size, key=1) != there).mean() > 0.9


@pytest.mark.parametrize("length,shard_size", [(16, 7), (64, None)])
def test_training_order_round_trip(spark, tmp_path, length, shard_size):
    for name, rows in (("corner", corner(spark)), ("docs", [(r["doc_id"], r["text"]) for r in documents(spark).collect()])):
        docs = frame(spark, rows)
        folder = f"file://{tmp_path}/{name}"
        index = sorted(trainingorder.materialised(docs, folder, trainingorder.public_vocabulary(), length=length, shard_size=shard_size).collect())
        assert [r["slot"] for r in index] == list(range(len(index)))
        size = shard_size or max(1, -(-len(index) // int(spark.conf.get("spark.sql.shuffle.partitions"))))
        tokens = trainingorder.read_slots(folder, 0, len(index), size)
        assert [zlib.crc32(t.tobytes()) for t in tokens] == [r["crc32"] for r in index]
        middle = len(index) // 3
        assert (trainingorder.read_slots(folder, middle, 5, size) == tokens[middle:middle + 5]).all()
        slots = trainingorder.permuted(np.arange(len(index)), len(index))
        flat = np.concatenate([tokens[s][:index[s]["n_tokens"]] for s in slots])
        encoding, texts, at = trainingorder.tokenizer(trainingorder.public_vocabulary()), [], 0
        for end in np.flatnonzero(flat == trainingorder.END):
            texts.append(encoding.decode(flat[at:end].tolist()))
            at = end + 1
        assert collections.Counter(texts) == collections.Counter(t or "" for _, t in rows)
        assert {i for r in index for i in r["doc_ids"]} == {i for i, _ in rows}
    bare = trainingorder.materialised(frame(spark, [(1, "a b c")]), f"{tmp_path}/bare", trainingorder.public_vocabulary(), length=16)
    assert bare.count() == 1 and trainingorder.located(spark, f"{tmp_path}/bare") == f"file://{tmp_path}/bare"
    assert trainingorder.read_slots(trainingorder.located(spark, f"{tmp_path}/bare"), 0, 1, 1)[0][-1] == trainingorder.END
    assert trainingorder.materialised(frame(spark, []), f"file://{tmp_path}/none", trainingorder.public_vocabulary()).count() == 0


# pages

PAGE = """<!DOCTYPE html><html><head><title>x</title><style>p{}</style><script>if (a<b) "</p>"</script></head><body class="page with-sidebar">
<header><a href=/>Site</a></header><div id="cookie-notice">We use cookies</div><nav><ul><li><a>Home</a><li><a>More</a></ul></nav><!-- <p>no</p> -->
<article><h1>Title &amp; more</h1><p>One <b>two</b>
three&nbsp;four<p title="hidden > a">Five<br>six</p><ul><li>a<li>b</ul><aside>side</aside><form><label>Name</label><input></form>
<table><tr><td>x<td>y<tr><td>z</table><p hidden>gone</p><div class="userComments"><p>c1</p></div></article><div class=sidebar>sb</div><footer>f</footer></body></html><p cla"""


def test_blocks_of_a_page():
    assert pagetext.main_text(PAGE, set()) == "Title & more\nOne two three four\nFive six\na\nb\nx\ny\nz"
    assert pagetext.main_text(None, set()) == pagetext.main_text("", set()) == pagetext.main_text("<script>x", set()) == ""
    assert pagetext.main_text("a < b &am c &lt;p&gt;", set()) == "a < b &am c <p>"
    assert [b.text for b in markup.blocks("<p><b>one<br><p>two</p></div>three")] == ["one", "two", "three"]
    assert pagetext.main_text("<div>" * 3000 + "deep" + "</div>" * 3000, set()) == "deep"


def test_templates_find_furniture_without_names(spark):
    def page(k):
        links = "".join(f"<li><a>to {k} {j}</a></li>" for j in range(4))
        return f"<body><div class=t1>Welcome to the same words</div><div class=t2><ul>{links}</ul></div><div class=t3><p>Story {k} begins</p><p>and ends {k}</p></div></body>"

    rows = [(k, f"http://one.example.com/{k}", page(k)) for k in range(6)] + [(50, "http://alone.example.com/", page(50)), (51, None, None), (52, "x", ""), (3, "http://one.example.com/3", page(3))]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id bigint, url string, html string, text string, host string")
    got = collections.defaultdict(set)
    out = pagetext.extracted(pages)
    assert out.columns == [*pages.columns, "main_text"]
    for r in out.collect():
        got[r["page_id"]].add(r["main_text"])
    assert all(got[k] == {f"Story {k} begins\nand ends {k}"} for k in range(6))
    assert got[50] == {"Welcome to the same words\nto 50 0\nto 50 1\nto 50 2\nto 50 3\nStory 50 begins\nand ends 50"} and got[51] == got[52] == {""}
    assert pagetext.extracted(pages.limit(0)).count() == 0


def page_texts(spark, rows):
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return {(r["page_id"], r["main_text"]) for r in pagetext.extracted(pages).collect()}


def test_copied_pages_and_repeated_rows_keep_their_text(spark):
    def page(k, banner="Welcome to all"):
        return f"<body><nav><a>at {k}</a></nav><div class=t1>{banner}</div><div class=t3><p>Story {k} begins</p><p>and ends {k}</p></div></body>"

    whole = "Welcome to all\nStory 1 begins\nand ends 1"
    copies = [(1, "http://a.com/1", page(1)), (2, "http://a.com/2", page(1).replace("at 1", "at 2"))]
    repeated = [(3, "http://b.com/1", page(1))] * 2
    assert page_texts(spark, copies + repeated) == {(k, whole) for k in (1, 2, 3)}
    dated = [(k, f"http://d.com/{k}", page(1, f"May {k}")) for k in (5, 6)]
    assert page_texts(spark, dated) == {(k, f"May {k}\nStory 1 begins\nand ends 1") for k in (5, 6)}
    doubled = [(k, f"http://c.com/{k}", page(k)) for k in range(4) for _ in range(2)]
    assert page_texts(spark, doubled) == {(k, f"Story {k} begins\nand ends {k}") for k in range(4)}


def test_teaser_articles_are_furniture(spark):
    teaser = "<article class=card><h2>Read this</h2><p>It is new</p></article>"
    rows = [(k, f"http://a.com/{k}", f"<div class=story><p>Story {k} begins here and goes on</p></div>{teaser}") for k in range(4)]
    assert page_texts(spark, rows) == {(k, f"Story {k} begins here and goes on") for k in range(4)}
    copies = [(k, f"http://b.com/{k}", f"<article><p>One story on two pages</p></article><div class=x>May {k}</div>") for k in range(2)]
    assert page_texts(spark, copies) == {(k, "One story on two pages") for k in range(2)}


def test_headings_that_half_of_the_pages_share_are_kept(spark):
    rows = [(k, f"http://a.com/{k}", f"<div class=t1>Hello</div><div class=t3>{'<h2>Background</h2>' if k % 2 else ''}<p>Story {k}</p></div>") for k in range(6)]
    assert page_texts(spark, rows) == {(k, "Background\n" * (k % 2) + f"Story {k}") for k in range(6)}


def test_pages_query_equals_plain_article(spark):
    import html

    source = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    rows = pagetext.op6(spark, SMALL).collect()
    assert len(rows) == len(source)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", source[r["page_id"]], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


# pieces


def darts(mapping):
    """A double array for a map of single bytes: the root's children lie at its offset; each holds its value one unit further."""
    units, texts = [0] * 1024, b""
    units[0] = 256 << 10
    for n, (byte, new) in enumerate(sorted(mapping.items())):
        node, value = 256 ^ byte, 600 + n
        units[node] = byte | 1 << 8 | ((node ^ value) << 10)
        units[value] = 1 << 31 | len(texts)
        texts += new + b"\0"
    return np.array([len(units) * 4, *units], "<u4").tobytes() + texts


def test_character_map_replaces_and_keeps_origins():
    model = pieces.Encoder(pieces.public_model())
    model.map = pieces.CharacterMap(darts({ord("A"): b"aa", ord("-"): b""}))
    norm, source = model.normalised("A-b é")
    assert norm.decode() == "▁aab▁é"
    assert source.tolist() == [0, 0, 0, 0, 0, 2, 3, 3, 3, 4, 4, 6]
    model.squeeze = True
    assert model.normalised("  b   A ")[0].decode() == "▁b▁aa"
    assert model.map.longest(b"xA", 0) is None and model.map.longest(b"xA", 1) == (1, b"aa")


def test_encoding_equals_the_library_and_spans_cover_the_text(spark):
    rng = random.Random(4)
    texts = [t for _, t in corner(spark)] + ["".join(rng.choice(" \n\tab▁é日🙂<0x>the") for _ in range(rng.randint(0, 50))) for _ in range(300)] + ["<s> </s> <unk>", "\x00"]
    rows = list(enumerate(texts))
    library = pieces.Encoder(pieces.public_model()).library
    for r in pieces.encoded(frame(spark, rows), pieces.public_model()).collect():
        text, p = texts[r["doc_id"]] or "", r["pieces"]
        assert p["ids"] == library.encode(text, add_eos=True) and p["decoded"] == library.decode(p["ids"])
        data = text.encode()
        assert b"".join(data[b:e] for b, e in zip(p["begins"], p["ends"], strict=True)) == data
        assert all(library.id_to_piece(i).replace("▁", " ").strip() == data[b:e].decode().replace("▁", " ").strip()
                   for i, b, e in zip(p["ids"], p["begins"], p["ends"], strict=True) if not library.is_byte(i) and not library.is_control(i))
    got = {r["doc_id"]: r["digests"] for r in pieces.encoding_digests(frame(spark, rows), pieces.public_model()).collect()}
    for i, t in rows:
        ids = library.encode(t or "", add_eos=True)
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.encoded(frame(spark, []), pieces.public_model()).count() == 0


# quality


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in quality.op8(spark, folder).collect()}
    docs = documents(spark, folder)
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    labels = [(r["quality"], rows[r["doc_id"]]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if rows[r["doc_id"]]["held_out"]]
    assert sum(q == r["predicted"] for q, r in labels) / len(labels) > 0.95


def test_quality_without_labels_and_with_odd_rows(spark):
    docs = frame(spark, corner(spark))
    none = spark.createDataFrame([], "doc_id bigint, quality int, text string")
    vectors, network = quality.fitted(docs, none)
    assert {r["s"] for r in quality.scored(docs, vectors, network, "s").collect()} == {0.5}
    odd = spark.createDataFrame([(4, 1, "t"), (4, 0, "t"), (None, 1, "t"), (5, None, "t"), (999, 1, "t"), (6, 1, "t"), (7, 0, "t")], "doc_id bigint, quality int, text string")
    vectors, network = quality.fitted(docs, odd)
    out = quality.scored(docs, vectors, network, "s").collect()
    assert len(out) == len(corner(spark)) and all(0 <= r["s"] <= 1 for r in out)
    again = quality.fitted(docs.repartition(7), odd)
    assert (again[0] == vectors).all()
    empty = frame(spark, [])
    assert quality.scored(empty, *quality.fitted(empty, none)).count() == 0


# licences


def test_licences_in_lines(spark):
    stated = [("Licensed under the Apache License, Version 2.0.", "apache"), ("released under the MIT license", "mit"), ("All rights reserved.", "proprietary"),
              ("This work is licensed under the GNU General Public License, version 3.", "gpl"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
              ("Licensed under the BSD 3-clause license", "bsd"), ("SPDX-License-Identifier: MPL-2.0", "mpl")]
    docs = [(k, f"Some words of a story\n{t}\nmore of it") for k, (t, _) in enumerate(stated)]
    docs += [(50, "A driver's license is required here."), (51, None), (52, ""), (53, "!!!"), (54, stated[1][0]), (54, stated[1][0]), (None, stated[1][0])]
    base = documents(spark).selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "'c' AS words", "'c' AS label", "1 AS n")
    found = licences.licences(frame(spark, docs).union(base)).where("confirmed AND (doc_id < 1000 OR doc_id IS NULL)").collect()
    want = [(k, 1, f) for k, (_, f) in enumerate(stated)] + [(54, 0, "mit"), (54, 0, "mit"), (None, 0, "mit")]
    assert sorted(((r["doc_id"], r["line"], r["family"]) for r in found), key=str) == sorted(want, key=str)
    assert licences.licences(frame(spark, [])).count() == 0


def test_licence_query_finds_every_planted_line(spark):
    plain = re.compile(r"^(Licensed under the Apache|Released under the MIT|This work is licensed under the GNU|All rights reserved\.$|Licensed under CC BY-NC)")
    want = {(r["doc_id"], k) for r in documents(spark).collect() for k, line in enumerate((r["text"] or "").split("\n")) if plain.match(line)}
    assert {(r["doc_id"], r["line"]) for r in licences.op9(spark, SMALL).collect()} == want


# joins


def brute_components(rows, width, percent):
    sets, parent = collections.defaultdict(list), {}
    for i, t in rows:
        sets[i].append(grams(t, width))
        parent[i] = i

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if i is not None)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                lo, hi = sorted((top(a), top(b)))
                parent[hi] = lo
    return collections.Counter((i, len(grams(t, width)), None if i is None else top(i)) for i, t in rows)


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_jaccard_components_equal_brute_force(spark, width, percent):
    rng = random.Random(width)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 300))
    rows, base = [], [word() for _ in range(80)]
    for k in range(60):  # a family whose members are alike to very different degrees
        own = [word() if rng.random() < 0.01 * (k % 7) else w for w in base]
        rows.append((100 + k, " ".join(own[:len(own) - k % 5])))
    for k in range(25):
        text = [word() for _ in range(rng.randint(1, 40))]
        rows += [(300 + 3 * k, " ".join(text)), (301 + 3 * k, " ".join([*text[:-1], word()])), (302 + 3 * k, "\n".join(text).upper())]
    rows += corner(spark)
    out = jaccardjoin.jaccard_components(frame(spark, rows), width, percent).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == brute_components(rows, width, percent)
    left = jaccardjoin.one_of_each(frame(spark, rows), width, percent)
    assert left.columns == frame(spark, []).columns
    groups = {(i, c) for i, _, c in brute_components(rows, width, percent)}
    assert {r["doc_id"] for r in left.collect()} == {i for i, c in groups if i == c}


def test_jaccard_of_an_empty_table_and_with_a_full_filter(spark):
    assert jaccardjoin.jaccard_components(frame(spark, [])).count() == 0
    out = jaccardjoin.jaccard_components(frame(spark, corner(spark)), bits=64).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == brute_components(corner(spark), 3, 90)


def test_components_of_a_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(30)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(31)}, **{100 + k: 100 for k in range(40)}, 200: 200, 201: 200}


def test_word_hashes_follow_words():
    texts = ["The  cat\tsat", "the cat", None, "", "THE\ncat sat ", "\x0b\x0c", "z" * 9000, "É é"]
    hashes, counts = word_hashes(texts)
    assert counts.tolist() == [3, 2, 0, 0, 3, 0, 1, 2] and len(set(hashes.tolist())) == 6
    sets = shingle_sets(texts, 3)
    assert sets[0].tolist() == sets[4].tolist() and [len(s) for s in sets] == [1, 1, 0, 0, 1, 0, 1, 1] and word_hashes([])[1].tolist() == []


# pipeline and queries


def test_pipeline_stage_by_stage_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = documents(spark, folder)
    columns = docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    library = pieces.Encoder(pieces.public_model()).library
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        given = docs.collect()
        docs = corpus_pipeline.written(stage(spark, docs, folder), "test-stage")
        got = docs.collect()
        if number < 4:
            assert docs.columns == columns, name
        ids = {r["doc_id"] for r in got}
        if name == "quality_classifier":
            sure = [r for r in given if r["doc_id"] in labels]
            assert sum((r["doc_id"] in ids) == labels[r["doc_id"]] for r in sure) >= 0.95 * len(sure)
        elif name == "line_dedup":
            want = {(i, t) for i, _, _, t in brute_lines([(r["doc_id"], r["text"]) for r in given])}
            assert {(r["doc_id"], r["text"]) for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)
        elif name == "near_copies":
            want = brute_components([(r["doc_id"], r["text"]) for r in given], 5, 80)
            assert ids == {i for i, _, c in want if i == c}
        elif name == "decontamination":
            low = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
            want = {r["doc_id"] for r in given if any(f" {low(t)} " in f" {low(r['text'])} " for t in items)}
            assert want and ids == {r["doc_id"] for r in given} - want
        else:
            texts = {r["doc_id"]: r["text"] for r in given}
            assert ids == set(texts) and all(r["ids"] == library.encode(texts[r["doc_id"]], add_eos=True) for r in got)


def test_every_operator_is_registered_once():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5
    assert set(entry.oracle_sql()) <= set(names)
