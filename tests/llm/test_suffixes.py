import pickle
import random

from sparkglyph.llm.bpe import Suffixes


def ending(words: dict[bytes, int], text: bytes) -> list[list[int]]:
    """By trying every word at every place."""
    by_length = sorted(words, key=len, reverse=True)
    return [[words[w] for w in by_length if text[:end].endswith(w)] for end in range(1, len(text) + 1)]


def test_words_that_end_at_each_place():
    rng = random.Random(5)
    for letters in (b"a", b"ab", b"abcd", bytes(range(250, 256))):
        for _ in range(60):
            words = {bytes(rng.choices(letters, k=rng.randrange(1, 9))): 0 for _ in range(rng.randrange(0, 25))}
            words = {w: k for k, w in enumerate(rng.sample(sorted(words), len(words)))}
            text = bytes(rng.choices(letters + b"z", k=60))
            built = Suffixes(words.items())
            again = pickle.loads(pickle.dumps(built))
            assert list(built.ending(text)) == list(again.ending(text)) == ending(words, text)


def test_one_state_for_strings_of_the_same_ends():
    built = Suffixes([(b"abcbc", 7), (b"bc", 8)])
    assert len(built.size) <= 2 * 7 and [built.word[s] for s in range(len(built.size)) if built.word[s] >= 0] == [7, 8]
