"""What a worker holds stays bounded, whatever the length of a text."""

import subprocess
import sys

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from flowlens.llm import shingles, tokens

PEAK = """
import random, resource, sys
sys.path.insert(0, {root!r})
from flowlens.llm import shingles, tokens
rng = random.Random(1)
words = [str(rng.randrange(10**6)) for _ in range(400_000)]
text = " ".join(rng.choice(words) + ("  " if rng.random() < 0.01 else "") for _ in range(2_900_000))[:20_000_000]
del words
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
before = peak()
{work}
print(peak() - before)
"""


def _growth(work):
    root = shingles.__file__.rsplit("/flowlens/", 1)[0]
    done = subprocess.run([sys.executable, "-c", PEAK.format(root=root, work=work)], capture_output=True, text=True, check=True)
    return int(done.stdout.split()[-1])


def test_hashing_a_text_of_20_million_characters():
    # The set itself takes 23 MB, the encoded text 20.
    assert _growth("assert len(shingles.Hasher().sets([text])[0]) > 2_000_000") < 150


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoding_a_text_of_20_million_characters(name):
    path = public_tokenizers.path(name)
    work = f"e = tokens.PieceEncoder({path!r}); assert len(e.encode([text])[0]) > 2_900_000; e.rest(); assert e.count <= tokens.RESTING_PIECES"
    assert _growth(work) < 350  # the vocabulary alone takes about 70 MB


def test_slices_do_not_change_sets(monkeypatch):
    text = " ".join(f"w{k * k % 977}" for k in range(60_000))
    texts = [text, "a b c", "", None, "x " * 10, text[:999], "y" * 5000 + " a b c d e"]
    whole = shingles.Hasher().sets(texts)
    for size in (100, 997, 4000):
        monkeypatch.setattr(shingles, "SLICE", size)
        assert all(np.array_equal(a, b) for a, b in zip(whole, shingles.Hasher().sets(texts)))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("pieces", [1_300_000, 50])
def test_blocks_do_not_change_ids(monkeypatch, name, pieces):
    monkeypatch.setattr(tokens, "BLOCK_CHARS", 101)
    monkeypatch.setattr(tokens, "PENDING_CHARS", 1000)
    monkeypatch.setattr(tokens, "MAX_PIECES", pieces)
    path = public_tokenizers.path(name)
    words = " ".join(f"w{k * k % 977}" for k in range(3000))
    texts = [words, "a  b " * 500 + "<|endoftext|> c " + words, "", None, "Ünï 日本 " * 300, " lead " + words + "  ", "x" * 900, "\t" + words]
    tokenizer = Tokenizer.from_file(path)
    ids, sizes = tokens.PieceEncoder(path).encode(texts)
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [tokens.END_ID] for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
