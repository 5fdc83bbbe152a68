"""Small documents with the hard cases: nulls, empties, ties, repeated rows, odd characters and a long text."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents() -> list[tuple]:
    rng = random.Random(7)
    words = ["the", "of", "Straße", "naïve", "don't", "it's", "##", "$5.00", "éé", "é", "́x", "<|endoftext|>", "a<|startoftext|>b", "İstanbul", "ΣΑΣ", "日本語", "🙂", "x y", "½", "1234", "...", "\\", "O'Neil's", "ǅ", "ẞ"]
    more = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(more) for _ in range(n))
    passage, other = prose(60), prose(40)
    texts = [
        None, "", " \t\n ", "one", "one two", "a a a a a", " ".join(words), "\n".join(words), prose(80) + ".",
        passage, prose(30) + " " + passage + " " + prose(30), passage + "\n" + prose(25), prose(12) + " " + other, other + " " + prose(9), other,
        prose(70) + ".\n" + prose(70) + ".", "é" * 49 + "ab", "x" + "é" * 49 + "abc", prose(4000), "repeat me " * 60, "z" * 300, "\x1c\x1d \x85   end", "same text twice. " * 3, "same text twice. " * 3,
    ]
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[9], (9, texts[10], None, None, None), (None, passage, "en", "s", 1), (None, None, None, None, None), (1000, texts[18], "en", "s", 2)]
    return rows
