import hashlib
import re

import numpy as np

from shelfmark.llm.crf import all_outside, best_path, negative_log_likelihood
from shelfmark.llm.pii import KINDS, as_text, base_spans, find_personal_data, luhn

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = [lambda: True, lambda: all(int(x) <= 255 for x in m[0].split(".")), lambda: 14 <= len(digits) <= 19 and luhn(digits),
                    lambda: 10 <= len(digits) <= 15][kind]
            if good():
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_match_the_patterns():
    rng = np.random.default_rng(3)
    alphabet = list("ab.@-+ 0123456789()%") + ["x@y.z", "4111111111111111", "+1 (234) 567-8901", "10.0.0.1", "é"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet, 25))
        assert base_spans(text) == plain_spans(text), text
    assert base_spans("a@b@c.de f@g.h.i+j@k.l") == plain_spans("a@b@c.de f@g.h.i+j@k.l")


class Holder:
    def __init__(self, moves):
        self.p = {"transitions": moves}


def test_crf_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(4)
    scores, moves = rng.normal(size=(4, 3, 2)), rng.normal(size=(3, 3))
    full = np.concatenate([np.zeros((4, 3, 1)), scores], 2)
    tags = rng.integers(0, 3, (4, 3))
    worth = lambda n, path: sum(full[t, n, k] for t, k in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))
    paths = list(product(range(3), repeat=4))
    loss = np.mean([np.log(sum(np.exp(worth(n, p)) for p in paths)) - worth(n, tags[:, n]) for n in range(3)])
    value, d, grads = negative_log_likelihood(Holder(moves), scores, tags)
    assert abs(value - loss) < 1e-5
    for target, gradient in ((scores, d), (moves, grads["transitions"])):
        at = tuple(0 for _ in target.shape)
        target[at] += 1e-5
        high = negative_log_likelihood(Holder(moves), scores, tags)[0]
        target[at] -= 2e-5
        low = negative_log_likelihood(Holder(moves), scores, tags)[0]
        target[at] += 1e-5
        assert abs((high - low) / 2e-5 - gradient[at]) < 1e-3
    found = best_path(scores, moves)
    assert all(tuple(found[:, n]) == max(paths, key=lambda p: worth(n, p)) for n in range(3))
    low = scores - 50
    assert all_outside(low, moves.copy()).all() and not best_path(low, moves).any()


def test_query_rows(documents, small):
    docs = small["documents"].select("doc_id", "text").collect()
    glued = "please call +1 (269) 555-3296 4524132264652876 and write to us"
    rows = [(r.doc_id, r.text, "en") for r in docs] + [(9001, None, "en"), (9002, "", None), (9003, glued, "en"), (9003, glued, "en")]
    rows += [(9100 + k, f"mail a{k}@b{k}.example.com or +1 (2{k:02}) 555-12{k:02} from 10.0.{k}.7 card 4111 1111 1111 1111 ok " * 2, "en") for k in range(60)]
    rows.append((9004, "word " * 100_000 + "a@b.cd", "en"))
    out = find_personal_data(documents(rows)).collect()
    assert len(out) == len(rows)
    texts = {i: t or "" for i, t, _ in rows}
    for r in out:
        base = plain_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [[k for _, k, _ in base].count(x) for x in range(4)]
        assert r.base_sha256 == hashlib.sha256(as_text(base).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert {f"{KINDS[k]}:{a}:{b}" for a, k, b in base} <= set(spans) and len(spans) == len(base) + r.n_added
    plain = [r for r in out if r.doc_id < 9000 and not plain_spans(texts[r.doc_id])]
    assert sum(r.n_added for r in plain) <= 0.02 * len(plain)
    assert find_personal_data(documents([])).count() == 0
