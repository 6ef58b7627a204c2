import random

from pyspark.sql import functions as F

from citeloom.operators.chunks import chunk_papers, pack


def simulate(counts, size, overlap):
    """Sentence by sentence, with explicit lists."""
    out, current, i = [], [], 0
    while i < len(counts):
        n = counts[i]
        if n > size:
            if current:
                out.append(("s", tuple(current)))
            current = []
            out += [("t", i, a, min(a + size, n)) for a in range(0, n, size)]
            i += 1
        elif sum(counts[k] for k in current) + n > size:
            out.append(("s", tuple(current)))
            tail = []
            for k in reversed(current):
                if tail and sum(counts[j] for j in tail) + counts[k] > overlap:
                    break
                tail.insert(0, k)
            current = tail if sum(counts[k] for k in tail) + n <= size else []
        else:
            current.append(i)
            i += 1
    return out + ([("s", tuple(current))] if current else [])


def test_pack_equals_simulation():
    random.seed(1)
    for _ in range(2000):
        counts = [random.choice([1, 3, 5, 8, 13, 29, 31, 70]) for _ in range(random.randint(0, 14))]
        size, overlap = random.choice([(30, 10), (30, 29), (10, 2), (64, 0)])
        got = [("s", tuple(range(a, b))) if f < 0 else ("t", a, f, e) for a, b, f, e in pack(counts, size, overlap)]
        assert got == simulate(counts, size, overlap), (counts, size, overlap)


def test_chunk_rows_number_across_sections_and_tables(spark):
    sentences = " ".join(f"Sentence number {i} has words." for i in range(6))
    row = ("p1", [(0, "abstract", "Short one."), (1, "method", sentences)], ["Short one. Sentence number 0 has", "words. Sentence number 4 has words."], [(3, "|a|")], "c")
    schema = ("paper_id string, sections array<struct<ord:int,name:string,text:string>>, pages array<string>, "
              "tables array<struct<page_number:int,markdown:string>>, collection_id string")
    rows = chunk_papers(spark.createDataFrame([row], schema), 13, 6).orderBy("chunk_index").collect()
    assert [r.chunk_id for r in rows] == [f"p1_{i}" for i in range(len(rows))]
    assert rows[0].section_name == "abstract" and rows[0].page_number == 1
    assert rows[-1].section_name == "table" and rows[-1].page_number == 3 and rows[-1].text == "|a|"
    first, second = rows[1].text, rows[2].text
    assert first.split(". ")[-1].rstrip(".") in second  # the overlap
    assert {r.collection_id for r in rows} == {"c"}


def test_oversize_sentence_is_cut_by_tokens(spark):
    text = " ".join(f"w{i}" for i in range(25))
    schema = "paper_id string, sections array<struct<ord:int,name:string,text:string>>"
    rows = chunk_papers(spark.createDataFrame([("p", [(0, "full_text", text)])], schema), 10, 2).orderBy("chunk_index").select("text").collect()
    assert "".join(r.text for r in rows) == text and len(rows) == 3


def test_blank_section_has_no_chunks(spark):
    schema = "paper_id string, sections array<struct<ord:int,name:string,text:string>>"
    assert chunk_papers(spark.createDataFrame([("p", [(0, "full_text", " \n ")])], schema)).filter(F.lit(True)).count() == 0
