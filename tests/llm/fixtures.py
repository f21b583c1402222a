"""Small tables with nulls, empty and long texts, ties, repeated rows, copies and passages that documents share."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
_WORDS = ["alpha", "beta", "gamma,", "delta", "épsilon", "zeta.", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi", "omicron", "pi", "rho", "sigma", "tau", "Upsilon"]


def prose(n: int, r: random.Random) -> str:
    return " ".join(r.choice(_WORDS) + str(r.randrange(40)) for _ in range(n))


def documents() -> list[tuple]:
    r = random.Random(5)
    base = [prose(60 + 7 * k, r) for k in range(8)]
    passage = prose(30, r)
    texts = [*base, base[0], base[1].upper(), base[2] + " tail", "x " + base[3], base[4][:200] + passage + base[4][200:], prose(40, r) + passage, passage + " " + prose(20, r), prose(3, r), "one", "", None, "  \n\t ", prose(5000, r), "a b c d e f " * 30]
    near = base[7].split()
    for k in range(6):
        w = list(near)
        w[k * 9] = f"edit{k}"
        texts.append(" ".join(w))
    shared = "This site uses biscuits and you must accept them all now.\n"
    texts += [shared + prose(30, r) for _ in range(30)]
    texts += ["Ünïcødé ÀÉÎ 漢字 " * 12 + prose(10, r), "Ünïcødé ÀÉÎ 漢字 " * 12 + prose(11, r)]
    rows = [(k, t, "en", f"src{k % 2}", None if t is None else len(t)) for k, t in enumerate(texts)]
    return [*rows, rows[5], (None, base[6], None, None, None), (None, None, None, None, None)]
