import random

import numpy as np

from staffline.llm import quality_rules, words


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def hashes(text, lower=False):
    ((_, found),) = words.buffers([text.encode()], lower=lower)
    return found.hashes.tolist()


def test_words_that_differ_have_other_hashes():
    for n in (64, 1024, 4096):
        one, other = thue_morse(n), thue_morse(n, "ba")
        a, b, again = hashes(f"{one} {other} {one}")
        assert a == again != b
        assert len(set(hashes(f"{one.upper()} {other} {one}", lower=True))) == 2


def test_a_line_is_repeated_only_if_it_is_the_same():
    one, other = thue_morse(1024), thue_morse(1024, "ba")
    for text, n in ((f"{one}\n{other}", 0), (f"{one}\n{other}\n{one}", 1)):
        ((_, found),) = words.buffers([text.encode()])
        assert quality_rules.count_words(found)[3].tolist() == [n]


def test_sums_are_polynomials_modulo_the_prime():
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcXYZé\U0001f600", k=rng.randint(1, 50))) for _ in range(200))
    raw = text.encode()
    ((_, found),) = words.buffers([raw])
    for start, end, h in zip(found.start.tolist(), found.end.tolist(), found.hashes.tolist()):
        value = sum((raw[i] + 1) * pow(words.BASE, i - start, words.PRIME) for i in range(start, end)) % words.PRIME
        assert h == words.mix(np.array([value], np.uint64) + np.array([end - start], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]


def test_very_long_spans(monkeypatch):
    plain = hashes("abc ABC abcd abc")
    monkeypatch.setattr(words, "LONGEST_SUM", 2)
    assert [hashes("abc ABC abcd abc").index(h) for h in hashes("abc ABC abcd abc")] == [plain.index(h) for h in plain]
    assert len(set(hashes("abc ABC abcd abc", lower=True))) == 2
