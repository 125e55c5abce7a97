"""A worker's store of encoded words holds each word once, starts anew within its bound, and changes no ids."""

import sys

from spanloom.llm import packing
from tokenizers import Tokenizer


def stores(encode):
    found, seen, todo = [], set(), [encode]
    while todo:
        f = todo.pop()
        for cell in getattr(f, "__closure__", None) or ():
            x = cell.cell_contents
            if isinstance(x, dict) and id(x) not in seen and x.keys() - {".", ","}:
                seen.add(id(x))
                found.append(x)
            elif callable(x) and id(x) not in seen and hasattr(x, "__closure__"):
                seen.add(id(x))
                todo.append(x)
    return found


def test_plain_words_are_held_once():
    encode = packing._encoder(packing.tokenizer_path())
    words = ["".join(chr(97 + (i // 26**k) % 26) for k in range(4)) for i in range(5000)]
    encode(" ".join(words))
    held = stores(encode)
    assert sum(map(len, held)) <= 5000 and sum(map(sys.getsizeof, held)) < 400_000


def test_a_small_store_gives_the_same_ids(monkeypatch):
    path = packing.tokenizer_path()
    tok, monkey = Tokenizer.from_file(path), "One TWO. two, three... a., x. É. É É, 12. 3.4, don't ab.cd Ünï, İx. ﬁn straße. "
    texts = [monkey * 3 + " ".join(f"Word{i}. word{i} wörd{i}," for i in range(n, n + 40)) for n in range(0, 400, 17)]
    for bound in (1, 150, 800_000):
        monkeypatch.setattr(packing, "STORE", bound)
        encode = packing._encoder(path)
        for text in texts:
            want = tok.encode(text, add_special_tokens=False).ids
            assert encode(text) == b"".join(i.to_bytes(4, "little") for i in want)
        assert bound > 150 or sum(map(len, stores(encode))) <= 400
