import random

import numpy as np
import pytest

from siltstone.llm import encodings, leakage, packing, repeated_lines

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def test_leaks_against_brute_force():
    rng = random.Random(5)
    passages = [(i, " ".join(rng.choices(WORDS, k=30))) for i in range(12)] + [(99, "too short"), (98, None)]
    texts = []
    for _ in range(60):
        words = rng.choices(WORDS, k=40)
        if rng.random() < 0.7:
            own = rng.choice(passages[:12])[1].split()
            at, n = rng.randrange(0, 15), rng.choice([11, 12, 13, 14])
            words[10:10] = own[at : at + n]
        texts.append(", ".join(words).upper() if rng.random() < 0.3 else "\n".join(words))
    texts += ["", "x"]
    expected = set()
    for d, text in enumerate(texts):
        w = leakage.WORDS.findall(text.lower())
        runs = {tuple(w[i : i + 13]) for i in range(len(w) - 12)}
        for k, (_, p) in enumerate(passages[:12]):
            v = p.split()
            if any(tuple(v[i : i + 13]) in runs for i in range(len(v) - 12)):
                expected.add((d, k))
    index = leakage.index_passages(passages)
    assert len(index.ids) == 12 and expected
    assert set(leakage.find_leaks([leakage.words_text(t) for t in texts], index)) == expected
    assert leakage.find_leaks([b"a b"], leakage.index_passages([])) == []


CLEAN = ["Die größte Straße führt über die Brücke zurück.", "La région protégée reçoit des élèves très tôt.", "El año próximo también habrá más canción.", "Каждая строка меняет пустую область.", "新的请求可以记录日志。", "Więcej źródeł włącza żądanie i pamięć.", "The café isn’t open — “maybe” later…"]


@pytest.fixture(scope="module")
def models():
    rng = random.Random(1)
    return encodings.fit_models(["\n".join(rng.choices(CLEAN, k=6)) for _ in range(300)])


@pytest.mark.parametrize(("text", "chain"), [(CLEAN[0], (("utf-8", "cp1252"),)), (CLEAN[1], (("utf-8", "cp1252"), ("utf-8", "cp1252"))), (CLEAN[3], (("cp1251", "cp1252"),)), (CLEAN[4], (("gb18030", "latin-1"),)), (CLEAN[5], (("cp1250", "cp1252"),)), (CLEAN[6], (("utf-8", "mac-roman"),))])
def test_garbled_text_comes_back(models, text, chain):
    broken = encodings.garble(text, chain)
    assert encodings.invert(broken, chain) == text
    verdict = encodings.judge(broken, models)
    assert verdict.garbled and verdict.restored == text and verdict.complete


def test_clean_and_quoted_text_is_left_alone(models):
    for text in [*CLEAN, "", "plain ascii", "Quoted `Ã©tÃ©` sample", "```\nÃ©tÃ©\n```\nnote"]:
        verdict = encodings.judge(text, models)
        assert not verdict.garbled and verdict.restored == text
    assert encodings.judge("Seg�n lost", models).garbled and not encodings.judge("a `�` sign", models).garbled


def test_best_fit():
    rng = random.Random(3)
    sizes = sorted((rng.randrange(1, 60) for _ in range(500)), reverse=True)
    bins = packing.best_fit(sizes, 100)
    filled = {}
    for size, number in zip(sizes, bins, strict=True):
        filled[number] = filled.get(number, 0) + size
    assert max(filled.values()) <= 100 and len(filled) <= -(-sum(sizes) // 100) + 3
    assert packing.best_fit([], 10) == []


def test_chunks_follow_content():
    rng = random.Random(4)
    words = rng.choices(WORDS, k=400)
    ends = repeated_lines.chunk_ends(words)
    assert ends[-1] == 400 and len(ends) > 5
    moved = repeated_lines.chunk_ends(["new"] * 3 + words)
    assert len({e + 3 for e in ends} & set(moved)) >= len(ends) - 2
    assert repeated_lines.chunk_hashes(words[:3]) == repeated_lines.chunk_hashes(words[:3])


def test_a_few_garbled_words_among_many_strange_ones(models):
    chain = (("utf-8", "cp1252"),)
    strange = " ".join("".join(chr(0x10A0 + (7 * i + 3 * k) % 38) for k in range(12)) for i in range(90))
    garbled = encodings.garble("größte Brücke", chain)
    assert encodings.judge(f"{strange} {garbled}", models).restored == f"{strange} größte Brücke"
    assert not encodings.judge(strange, models).garbled


def test_a_chain_of_low_rank_is_tried(models):
    ranks = encodings.Models(models.clean, np.concatenate([np.repeat(models.ratios.max(axis=0, keepdims=True), 9, axis=0), models.ratios]), models.first, [(("cp437", "cp1252"),)] * 9 + models.chains)
    broken = encodings.garble(CLEAN[0], (("utf-8", "cp1252"),))
    assert encodings.judge(broken, ranks).restored == CLEAN[0]


@pytest.mark.parametrize(("text", "times", "chain"), [("The café isn’t open", 1, None), ("it isn’t open ", 200, (("mac-roman", "cp1252"),))])
def test_signs_that_do_not_stand_elsewhere(models, text, times, chain):
    broken = encodings.garble(text, chain) * times if chain else text
    verdict = encodings.judge(broken, models)
    assert verdict.garbled == (chain is not None) and verdict.restored == text * times


def test_lone_signs_are_no_letters(models):
    assert not encodings.judge("It costs € or £ here. " * 20, models).garbled


def test_a_run_behind_a_rewritten_part_of_other_word_count():
    first, last = [f"first{i}x" for i in range(5)], [f"second{i}y" for i in range(13)]
    text = " ".join([*first, *["ab"] * 40, *last])
    passage = " ".join([*first, *["abcde"] * 20, *last])
    assert leakage.find_leaks([leakage.words_text(text)], leakage.index_passages([(1, passage)])) == [(0, 0)]


@pytest.mark.parametrize(("text", "chain"), [("La région protégée reçoit des élèves", (("cp1252", "mac-roman"),)), ("La région protégée des élèves", (("cp1252", "cp850"),)), ("Каждая строка меняет пустую область.", (("koi8-r", "cp1251"),))])
def test_letters_that_stay_letters_of_the_same_script(models, text, chain):
    broken = encodings.garble(text, chain)
    verdict = encodings.judge(f"{broken}\n{' '.join(CLEAN)}", models)
    assert verdict.garbled and verdict.restored.startswith(text)


def test_quotation_marks_are_no_letters(models):
    for text in ("„leere „schnelle “local lazy” «oui»", "OPÇÕES LÖSUNG ÉQUIPE"):
        assert not encodings.judge(f"{text}\n{CLEAN[0]}", models).garbled


def brute_edited(a, b, edits):
    """Most equal words of an alignment of some stretches of a and b with at most so many edits, by trying all."""
    best = 0

    def go(i, j, run, left):
        nonlocal best
        best = max(best, run)
        if i < len(a) and j < len(b) and a[i] == b[j]:
            go(i + 1, j + 1, run + 1, left)
        elif left:
            go(i + 1, j + 1, run, left - 1)
        if left:
            go(i + 1, j, run, left - 1)
            go(i, j + 1, run, left - 1)

    for i in range(len(a)):
        for j in range(len(b)):
            go(i, j, 0, edits)
    return best


def test_edited_runs_against_brute_force():
    rng = random.Random(11)
    for _ in range(60):
        a = [bytes([97 + rng.randrange(3)]) for _ in range(rng.randrange(0, 7))]
        b = [bytes([97 + rng.randrange(3)]) for _ in range(rng.randrange(0, 7))]
        for edits in (0, 1, 2):
            assert leakage.edited_run(a, b, 8, edits) == brute_edited(a, b, edits), (a, b, edits)
        assert leakage.longest_run(a, b, 8) == leakage.edited_run(a, b, 8, 0)


def test_an_edit_inside_a_run():
    words = [f"word{chr(97 + i)}{i * 7}" for i in range(16)]
    changed, longer, shorter = [*words[:7], "other", *words[8:]], [*words[:7], "other", *words[7:]], [*words[:7], *words[8:]]
    for text, expected in ((changed, [(0, 0)]), (longer, [(0, 0)]), (shorter, [(0, 0)]), (["x"] * 16, [])):
        data = [leakage.words_text(" ".join(["before", "that", *text, "after", "it"]))]
        passages = [(5, " ".join(words))]
        assert leakage.find_leaks(data, leakage.index_passages(passages, 13, 1), 13, 1) == expected, text
        assert leakage.find_leaks(data, leakage.index_passages(passages)) == []
