import random

import numpy as np

from attrition.llm import langid as L

WORDS = {"en": "the and with thing mother weather which shall", "de": "und der nicht schön über straße zeit ich",
         "xx": "qoq zyz qyq zoz yqy oqo zqz"}


def texts(n, seed=1):
    rnd = random.Random(seed)
    return [(k, " ".join(rnd.choices(WORDS[lang].split(), k=rnd.randrange(3, 40))), lang, "s")
            for k, lang in ((k, rnd.choice(list(WORDS))) for k in range(n))]


def test_trigrams():
    codes, counts = L.trigrams("Aa, aA!")
    spell = lambda c: "".join(chr(int(c) >> s & (1 << 21) - 1) for s in (42, 21, 0))
    assert dict(zip(map(spell, codes), counts.tolist())) == {" aa": 2, "aa ": 2, "a a": 1}
    assert len(L.trigrams("12 ?!")[0]) == 0


def test_vectors_are_nearly_orthogonal_and_do_not_depend_on_the_memo():
    codes = L.trigrams("the quick brown fox jumps over the lazy dog")[0]
    small = L.Vectors(kept=10)
    made = L.Vectors()(codes).astype(int)
    assert (np.vstack([small(codes[k:k + 4]) for k in range(0, len(codes), 4)]) == made).all()
    dots = made @ made.T / L.SIZE
    assert (np.diag(dots) == 1).all() and np.abs(dots - np.eye(len(codes))).max() < 0.2


def test_profile_is_the_bundle_of_bound_letters():
    def letter(c):
        return L.Vectors().letters(np.array([ord(c)], np.uint64))[0].astype(int)

    gram = lambda s: np.roll(letter(s[0]), 2) * np.roll(letter(s[1]), 1) * letter(s[2])
    total = gram(" ab") + gram("ab ")
    assert np.allclose(L.profile("ab"), total / np.linalg.norm(total))


def test_held_out_accuracy(docs_of):
    docs = docs_of(texts(400))
    model = L.prototypes(docs.where(~L.held_out("doc_id")))
    assert model[0] == ["de", "en", "xx"]
    rows = {r.doc_id: r for r in L.predict(docs, *model).collect()}
    truth = {k: lang for k, _, lang, _ in texts(400)}
    tested = [r.lang_pred == truth[k] for k, r in rows.items() if r.held_out]
    assert 50 < len(tested) < 120 and np.mean(tested) > 0.97
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_odd_texts(docs_of):
    model = L.prototypes(docs_of([*texts(50), (70, "zzz", None, "s")]))
    odd = [(1, None), (2, ""), (3, "12 ?!"), (4, "the mother " * 90_000), (None, "und nicht"), (4, "the mother " * 90_000)]
    got = [(r.doc_id, r.lang_pred) for r in L.predict(docs_of(odd), *model).collect()]
    assert sorted(got, key=str) == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "de")], key=str)


def test_nothing_to_learn_or_predict(docs_of):
    model = L.prototypes(docs_of([]))
    assert [r.lang_pred for r in L.predict(docs_of([(1, "the")]), *model).collect()] == ["und"]
    assert L.predict(docs_of([]), *model).count() == 0
