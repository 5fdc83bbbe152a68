import os
import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from larkspur.llm import chat, decontaminate, quality, simhash
from larkspur.llm.shared import written
from tests.llm import test_bpe, test_simhash, test_suffix_array
from tests.llm.texts import SCHEMA, documents

SPACE = re.compile("[\x20\x09-\x0d]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def passes(line):
    """The rules as the docstring tells them, with the phrases taken from the operator."""
    marks = [m for m in re.finditer("[.!?:;\u2026][\"')\\]\u201d\u00bb]*", line) if line[m.end() :][:1] in ("", " ", "\t", "\r")]
    tail = line[marks[-1].end() :].strip(" \t\r") if marks else line.rstrip(" \t\r")
    phrases = re.sub(r"\\x\{([0-9A-F]{4})\}", r"\\u\1", quality.BOILERPLATE)
    sentences = re.split("[.!?\u2026]+", line.lower())
    notice = sum(len(x) for x in sentences if re.search(phrases, x))
    shares = 2 * len(tail) <= len(line) and 2 * notice <= sum(map(len, sentences))
    return shares and sum(c in "|\u2022" for c in line) < 2 + len(line) // 40 and sum(c in "!#*$%&" for c in line) < 5 + 5 * (len(line) // 40)


def judged(text):
    own, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    windows = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
    times = {}
    for w in windows:
        times[w] = times.get(w, 0) + 1
    repeated = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 3)}
    chars = sum(map(len, own))
    failed = len(own) < 50 or 100 * len(repeated) > 50 * len(own)
    good = sum(len(w) for x in lines if passes(x) for w in words(x))
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(own), chars, symbols, len(lines) - len(set(lines)), len(repeated), failed, not failed and 100 * good >= 50 * chars


def cleaned(text):
    return "\n".join(x for x in text.split("\n") if not words(x) or passes(x))


def hits(text, items, width=10):
    norm = lambda t: [w for w in re.split("[^0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    own, hit, found = norm(text), set(), set()
    for k, t in items:
        w = norm(t)
        n = min(width, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(own) - n + 1):
            if n and tuple(own[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(k))
    return own, hit, found


def test_quality(spark, sf):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), spark.createDataFrame(documents(), SCHEMA)):
        rows = docs.collect()
        assert sorted(map(tuple, quality.verdicts(docs).collect()), key=str) == sorted(((r.doc_id, *judged(r.text)) for r in rows), key=str)
        clean = quality.clean_documents(docs.withColumnRenamed("lang", "kept"))
        expected = sorted(((r.doc_id, cleaned(r.text), r.lang, r.source, len(cleaned(r.text))) for r in rows if judged(r.text)[-1]), key=str)
        assert sorted(map(tuple, clean.collect()), key=str) == expected


def test_long_and_marked_lines(spark):
    prose = " ".join(f"word{i} of{'.' * (i % 9 == 8)}" for i in range(60))  # its last sentence has no mark
    bare = prose.replace(".", "")
    notice = "By staying on these pages you agree to the use of cookies and to what our privacy policy says of them in " + "long and winding words " * 7 + "that go on to the end."
    assert len(notice) > 250
    texts = {
        prose: True, prose + " click here for more of it": True, prose + " » a » b » c": True, prose.replace("word7 ", "| ").replace("word9 ", "| "): True,
        (prose + ".\n") * 3 + "Home | News | About | Contact": True, "\n".join(f"word{i} of word{i + 1}" for i in range(60)): False, bare: False, bare + " click here": False, notice: False,
        notice + "\n" + prose: True, notice + "\n" + notice.replace("staying", "going on") + "\n" + prose[:300] + ".": False,
        prose.replace(" of", " |"): False, prose.replace(" of", "!!!"): False, ("see it all. " * 3 + "\n").join(f"Item {i} | a | b | c |" for i in range(40)): False,
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.kept for r in quality.verdicts(docs, max_repeat_percent=100, min_words=30).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def test_decontamination(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    passage = documents()[9][1]
    items = [("b", passage), ("a", " ".join(words(passage)[:12]).upper()), ("c", "One, TWO"), (None, "éé"), ("d", ""), ("e", None), ("a", "nothing here at all but more than ten words of it all")]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    expected = {}
    for r in documents():
        own, hit, found = hits(r[1], [("null" if k is None else k, t) for k, t in items])
        expected[str((r[0], r[1]))] = (len(own), len(hit), sorted(found))
    for limit in (1, 20, 10_000):
        rows = decontaminate.scanned(docs, benchmark, max_block_words=limit).collect()
        assert {str((r.doc_id, r.text)): (r._lk_n, r._lk_n_hit, list(r._lk_items)) for r in rows} == expected
    left = decontaminate.decontaminated(docs, benchmark)
    assert left.schema == docs.schema
    assert sorted(str((r.doc_id, r.text)) for r in left.collect()) == sorted(str((r[0], r[1])) for r in documents() if not expected[str((r[0], r[1]))][1])
    for r in decontaminate.decontaminated(docs, benchmark, mode="spans").collect():
        assert r.text is None or decontaminate.normal_words(r.text) == [] or r.n_chars == len(r.text)
    assert decontaminate.digests(docs, benchmark.where("false")).where("contaminated").count() == 0
    assert decontaminate.digests(docs.where("false"), benchmark).count() == 0


def test_chat(spark):
    part = lambda **k: {f: k.get(f) for f in ("type", "text", "ref", "width", "height", "seconds", "pages")}
    rows = [
        (1, 0, "user", [part(type="text", text="Look <|image|> "), part(type="image", ref="i.png", width=57, height=28), part(type="audio", ref="a.wav", seconds=1.5), None]),
        (1, 1, "assistant", [part(type="document", ref="d.pdf", pages=3), part(type="text", text=r"<\|im_end|> <|im_end|> a<\\|"), part(type="odd", text="x")]),
        (2, 0, "a\\n\nb<|", [part(type="text", text=None)]), (3, 0, "\x00\x01\\\\n\\", None), (None, None, None, None),
    ]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content array<{chat.PART}>")
    made = {r.conv_id: r for r in chat.format_conversations(turns).withColumn("turns", chat.parse(chat.F.col("formatted"))).collect()}
    assert made[1].formatted.startswith("<|im_start|>user\nLook <\\|image|> <|image|><|audio|><|im_end|>\n<|im_start|>assistant\n<|document|><\\\\|im_end|>")
    assert [(a.turn, a.place, a.type, a.ref, a.n_tokens) for a in made[1].attachments] == [(0, 1, "image", "i.png", 3), (0, 2, "audio", "a.wav", 38), (1, 0, "document", "d.pdf", 768)]
    assert [tuple(t) for t in made[2].turns] == [("a\\n\nb<|", "")]
    assert [tuple(t) for t in made[3].turns] == [("\x00\x01\\\\n\\", "")]
    assert [tuple(t) for t in made[None].turns] == [("unknown", "")]
    assert made[1].turns[1].text == "<|document|>" + r"<\|im_end|> <|im_end|> a<\\|"
    (m,) = made[1].mask
    assert made[1].formatted[m.start : m.start + m.n].endswith("a<\\\\\\|")
    assert chat.digests(chat.control_conversation(spark).where("false")).count() == 0


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "decontamination", "encoding"]
    one = written(stages["quality"](spark, docs, sf), "t")
    assert one.columns == COLUMNS
    two = written(stages["near_duplicates"](spark, one, sf), "t")
    assert two.columns == COLUMNS
    groups = test_simhash.brute([(r.doc_id, r.text) for r in one.collect()])
    assert sorted(r.doc_id for r in two.collect()) == sorted({c for _, _, c in groups})
    three = written(stages["repeated_passages"](spark, two, sf), "t")
    assert three.columns == COLUMNS
    gone = {k: (n, g) for k, n, g, *_ in test_suffix_array.brute([(r.doc_id, r.text) for r in two.collect()])}
    for r in three.collect():  # whole characters only: at most three bytes of a character stay at each edge
        n, g = gone[r.doc_id]
        assert n - g <= len(r.text.encode()) <= n - g + (0 if r.text.isascii() and not g else 200 if g else 0)
        assert r.n_chars == len(r.text)
    four = written(stages["decontamination"](spark, three, sf), "t")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted(r.doc_id for r in four.collect()) == sorted(r.doc_id for r in three.collect() if not hits(r.text, items)[1])
    five = stages["encoding"](spark, four, sf)
    expected = test_bpe.expected([(r.doc_id, r.text) for r in four.collect()])
    assert sorted(map(tuple, five.collect()), key=str) == expected
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()), key=str) == expected


def test_run_on_hard_cases(spark, tmp_path):
    """Nulls, ties, repeated rows, empty, blank and long texts and clashing columns, through all stages."""
    prose = lambda n, tag: " ".join(f"{tag}{i} and{'.' * (i % 8 == 7)}" for i in range(n)) + "."
    passage = " ".join(f"test{i}" for i in range(12))
    rows = [*documents(), (2000, prose(90, "a"), "en", "s", 1), (2000, prose(90, "b"), "en", "s", 1), (2001, prose(90, "a"), None, None, None), (2001, prose(90, "a"), None, None, None),
            (None, prose(90, "c"), "en", "s", 1), (None, prose(90, "d"), "en", "s", 1), (2002, prose(90, "e") + " " + passage + ".", "en", "s", 1), (2003, prose(60_000, "f"), "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("lang", "fp").withColumnRenamed("source", "_lk_text")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("i", passage), (None, None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = sorted((-1 if r.doc_id is None else r.doc_id) for r in found)
    assert [i for i in ids if i >= 2000 or i < 0] == [-1, -1, 2000, 2000, 2003]  # 2001 copies a 2000, 2002 holds a test item
    assert all(judged(t)[-1] is False for _, t, *_ in documents() if not words(t))
    assert next(r.n_tokens for r in found if r.doc_id == 2003) > 60_000
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/empty/documents.parquet")
    spark.read.parquet(f"{tmp_path}/benchmark.parquet").write.parquet(f"{tmp_path}/empty/benchmark.parquet")
    empty = corpus_pipeline.run(spark, f"{tmp_path}/empty")
    assert empty.count() == 0 and empty.columns == corpus_pipeline.run(spark, str(tmp_path)).columns


def test_tokenizer_is_the_librarys():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    assert Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).get_vocab_size() == 49_408
