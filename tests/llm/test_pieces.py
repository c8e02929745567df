import random

import pytest

from factloom.llm import pieces
from factloom.llm.pieces import Rule, cut_files, cut_pieces, faulty_chunks


def brute(text, rule):
    out, start = [], 0
    while text:
        end = min(start + rule.limit, len(text))
        if end < len(text):
            end = next((e for e in range(end, end - rule.reach, -1) if text[e - 1] in " \n"), end)
        out.append((start, end, text[start:end]))
        if end == len(text):
            return out
        start = end - rule.overlap
    return out


def texts():
    rng = random.Random(5)
    letters = "ab é₹𝟤 \n"
    made = ["".join(rng.choice(letters) if rng.random() < 0.3 else "x" for _ in range(rng.randrange(700))) for _ in range(40)]
    return [None, "", " ", "x" * 1000, "é" * 333, " " * 500, "a " * 200, *made, *made[:3], "".join(rng.choice(letters) for _ in range(9000))]


@pytest.mark.parametrize("size", [7, 64, 1000, 65_536])
def test_pieces_equal_a_plain_loop_for_any_range_size(spark, size):
    rule = Rule(limit=40, overlap=10, reach=8, range_bytes=size)
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "id long, text string, piece_no string")
    got = {}
    for r in cut_pieces(df, "id", "text", rule).collect():
        got.setdefault(r.id, []).append((r.piece_no, r.char_offset, r.char_end, r.text))
    for k, t in rows:
        want = [(n, *x) for n, x in enumerate(brute(t or "", rule))]
        assert sorted(got.get(k, [])) == want, (k, size)


@pytest.mark.parametrize("size", [16, 65_536])
def test_faulty_chunks(spark, size):
    rule = Rule(limit=40, overlap=10, reach=8, range_bytes=size)
    page = "".join(random.Random(2).choice("abcdef  é\n") for _ in range(300))
    good = brute(page, rule)
    page_rows = [(1, 7, 0, page), (2, 8, 0, page), (3, 9, 0, page), (4, None, 0, page), (5, 10, 0, "")]
    chunk = lambda cid, doc, seq, off, text, prefix=0: (cid, doc, 0, seq, off, prefix, text)
    rows = [chunk(100 + n, 7, n, s, t) for n, (s, e, t) in enumerate(good)]
    bad = [list(x) for x in good]
    bad[1] = [bad[1][0], bad[1][1], "HEAD " * 9 + bad[1][2]]
    rows += [chunk(200 + n, 8, n, s, t, 45 if n == 1 else 0) for n, (s, e, t) in enumerate(map(tuple, bad))]
    rows += [chunk(300, 9, 0, 0, page[:39]), chunk(301, 9, 1, 31, page[31:60]), chunk(302, 9, 2, None, None), chunk(303, 11, 0, 5, "y" * 41), chunk(304, None, 0, 0, "z")]
    chunks = spark.createDataFrame(rows, "id long, document_id long, page_index int, seq int, char_offset int, header_prefix_len int, text string")
    pages = spark.createDataFrame(page_rows, "id long, document_id long, page_index int, text string")
    got = {r.chunk_id: r for r in faulty_chunks(chunks, pages, rule).collect()}
    assert len(got) == len(rows)
    assert not any(any(got[100 + n][1:]) for n in range(len(good)))
    assert got[201].too_long and not got[201].wrong_overlap and not got[202].wrong_overlap
    assert got[301].wrong_overlap and got[303].too_long and not any(got[304][1:])
    assert got[300].misses_boundary == (page[38] not in " \n" and any(c in " \n" for c in page[31:39]))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, document_id long, page_index int, seq int, char_offset int, header_prefix_len int, text string")
    assert cut_pieces(none, "id", "text").collect() == [] and faulty_chunks(none, none).collect() == []


def test_files_of_many_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pieces, "FAN", 3)  # three levels of a small tree
    rule = Rule(limit=40, overlap=10, reach=8, range_bytes=50)
    made = {"a.txt": "".join(random.Random(1).choice("ab é₹ \n") for _ in range(4000)), "b.txt": "short", "c.txt": "", "d.txt": "é" * 900}
    for name, text in made.items():
        (tmp_path / name).write_text(text, encoding="utf-8", newline="")
    got = {}
    for r in cut_files(spark, str(tmp_path), rule).collect():
        got.setdefault(r.path[-5:], []).append((r.piece_no, r.char_offset, r.char_end, r.text))
    for name, text in made.items():
        assert sorted(got.get(name, [])) == [(n, *x) for n, x in enumerate(brute(text, rule))], name
