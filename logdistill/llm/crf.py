"""A linear-chain conditional random field over words, in numpy.

A word scores each language by weights of its character bigrams and trigrams (with word
borders), its prefix and suffix of four letters, and the word itself (lexicon).  Learned
transition weights tie neighbouring words.  Word labels are the marginals of the
forward-backward pass, which is exact for texts of any length: texts are cut into blocks
whose transfer matrices are chained.
"""

from __future__ import annotations

import numpy as np

BIGRAMS, TRIGRAMS, AFFIXES, LEXICON = 1 << 14, 1 << 17, 1 << 16, 1 << 17
BLOCK = 64
AFFIX = 4
PIECE = 120_000
_P = np.uint64(0x100000001B3)


def _hash(x: np.ndarray, size: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(40)) % np.uint64(size)).astype(np.int64)


class Words:
    """Feature places of all words of some texts.

    ``owner``: text index by word.  ``grams``: (bigram, trigram) places by character place,
    with ``begin`` the first place of each word.  ``affix`` [n, 2] and ``lexicon`` [n].
    """

    def __init__(self, texts: list[str]):
        flat = "\n".join(t.lower() for t in texts) + "\n\n"
        sizes = np.array([len(t.lower()) + 1 for t in texts], dtype=np.int64)
        codes = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letters = np.zeros(int(codes.max()) + 1, dtype=bool)
        for c in np.flatnonzero(np.bincount(codes)):
            letters[c] = chr(c).isalpha()
        inside = letters[codes]
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.n = len(start)
        self.owner = np.searchsorted(np.cumsum(sizes), start, side="right")
        if not self.n:
            return
        z = np.where(inside, codes, 0).astype(np.uint64)
        length = end - start
        # Places from the first letter to the border behind the last one.
        self.begin = np.concatenate(([0], np.cumsum(length + 1)[:-1]))
        at = np.arange(int((length + 1).sum())) + np.repeat(start - self.begin, length + 1)
        prev = np.where(at > 0, z[at - 1], np.uint64(0))
        back = np.where((at > 1) & (prev > 0), z[at - 2], np.uint64(0))
        two = prev << np.uint64(21) | z[at]
        self.two = _hash(two, BIGRAMS)
        self.three = _hash(back << np.uint64(42) | two, TRIGRAMS)
        head = np.zeros(self.n, np.uint64)
        tail = np.ones(self.n, np.uint64)
        for k in range(AFFIX):
            ok = k < length
            head = head * _P + np.where(ok, z[np.minimum(start + k, end - 1)], np.uint64(0))
            tail = tail * _P + np.where(ok, z[np.maximum(end - 1 - k, start)], np.uint64(0))
        self.affix = np.stack([_hash(head, AFFIXES), _hash(tail, AFFIXES)], axis=1)
        power = np.full(int(length.max()) + 1, _P, dtype=np.uint64)
        power[0] = 1
        power = np.cumprod(power)
        places = np.flatnonzero(inside)
        value = z[places] * power[places - np.repeat(start, length)]
        self.lexicon = _hash(np.add.reduceat(value, np.concatenate(([0], np.cumsum(length)[:-1]))), LEXICON)


def gathered(texts: list[str], piece: int = 300_000) -> Words:
    """``Words`` of many texts, made in pieces and held in narrow integers."""
    whole = Words([])
    kept: dict[str, list[np.ndarray]] = {n: [] for n in ("owner", "begin", "two", "three", "affix", "lexicon")}
    at = places = 0
    while at < len(texts):
        stop, chars = at, 0
        while stop < len(texts) and (stop == at or chars + len(texts[stop]) <= piece):
            chars += len(texts[stop])
            stop += 1
        w = Words(texts[at:stop])
        if w.n:
            parts = {"owner": w.owner + at, "begin": w.begin + places}
            for name, into in kept.items():
                into.append((parts[name] if name in parts else getattr(w, name)).astype(np.int32))
            whole.n += w.n
            places += len(w.two)
        at = stop
    if whole.n:
        for name, into in kept.items():
            setattr(whole, name, np.concatenate(into))
    return whole


def zero_model(languages: list[str]) -> dict:
    k = len(languages)
    sizes = {"two": BIGRAMS, "three": TRIGRAMS, "affix": AFFIXES, "lexicon": LEXICON}
    model = {name: np.zeros((size, k), dtype=np.float32) for name, size in sizes.items()}
    return model | {"languages": languages, "chain": np.zeros((k, k), dtype=np.float32)}


def emissions(model: dict, w: Words) -> np.ndarray:
    """Scores [words, languages]."""
    if not w.n:
        return np.zeros((0, len(model["languages"])), dtype=np.float32)
    grams = model["two"][w.two] + model["three"][w.three]
    return (
        np.add.reduceat(grams, w.begin, axis=0)
        + model["affix"][w.affix].sum(axis=1)
        + model["lexicon"][w.lexicon]
    )


def _softened(scores: np.ndarray) -> np.ndarray:
    return np.exp(scores - scores.max(axis=-1, keepdims=True)).astype(np.float64)


def marginals(model: dict, scores: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Label marginals [words, languages]; text i has the words bounds[i]:bounds[i+1]."""
    k = scores.shape[1]
    if not len(scores):
        return scores.astype(np.float64)
    e, chain = _softened(scores), np.exp(model["chain"].astype(np.float64))
    # Blocks of each text, with their order in the text.
    count = np.diff(bounds)
    n_blocks = -(-count // BLOCK)
    text = np.repeat(np.arange(len(count)), n_blocks)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    first = bounds[:-1][text] + nth * BLOCK
    size = np.minimum(BLOCK, bounds[1:][text] - first)
    order = np.argsort(-size, kind="stable")
    text, nth, first, size = text[order], nth[order], first[order], size[order]
    live = [int((size > t).sum()) for t in range(int(size.max()))]

    forward = np.full((len(text), k), 1.0 / k)
    behind = np.ones((len(text), k))
    longer = np.flatnonzero(n_blocks[text] > 1)
    if len(longer):
        # Transfer matrices of blocks of texts with several blocks.
        m = np.tile(np.eye(k), (len(text), 1, 1))
        for t, n in enumerate(live):
            own = longer[longer < n]
            step = (m[own] @ chain) * e[first[own] + t][:, None, :]
            m[own] = step / step.sum(axis=(1, 2), keepdims=True)
        where = {(int(text[i]), int(nth[i])): i for i in longer}
        for i in sorted(longer, key=lambda i: nth[i]):
            after = where.get((int(text[i]), int(nth[i]) + 1))
            if after is not None:
                v = forward[i] @ m[i]
                forward[after] = v / v.sum()
        for i in sorted(longer, key=lambda i: -nth[i]):
            before = where.get((int(text[i]), int(nth[i]) - 1))
            if before is not None:
                v = m[i] @ behind[i]
                behind[before] = v / v.sum()

    out = np.empty((len(scores), k))
    for t, n in enumerate(live):
        v = (forward[:n] @ chain) * e[first[:n] + t]
        forward[:n] = v / v.sum(axis=1, keepdims=True)
        out[first[:n] + t] = forward[:n]
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        rows = first[:n] + t
        out[rows] *= behind[:n]
        v = (e[rows] * behind[:n]) @ chain.T
        behind[:n] = v / v.sum(axis=1, keepdims=True)
    return out / out.sum(axis=1, keepdims=True)


def _pair_expectation(model: dict, scores: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Marginals and expected transitions of sequences that all have ``length`` words."""
    k = scores.shape[1]
    e = _softened(scores).reshape(-1, length, k)
    chain = np.exp(model["chain"].astype(np.float64))
    alpha = np.empty_like(e)
    v = np.full((len(e), k), 1.0 / k)
    for t in range(length):
        v = (v @ chain) * e[:, t]
        v /= v.sum(axis=1, keepdims=True)
        alpha[:, t] = v
    beta = np.ones((len(e), k))
    pairs = np.zeros((k, k))
    marg = np.empty_like(e)
    for t in range(length - 1, -1, -1):
        g = alpha[:, t] * beta
        marg[:, t] = g / g.sum(axis=1, keepdims=True)
        right = e[:, t] * beta
        if t:
            joint = alpha[:, t - 1][:, :, None] * chain[None] * right[:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        beta = right @ chain.T
        beta /= beta.sum(axis=1, keepdims=True)
    return marg.reshape(-1, k), pairs


def fit(
    texts: list[str], labels: list[str], epochs: int = 3, length: int = 32, batch: int = 256,
    rate: float = 0.3, l2: float = 1e-4, seed: int = 11,
) -> dict:
    """Fit on labelled texts.  Training sequences switch between texts of random languages
    after random spans, so that transitions are learned from switches too."""
    languages = sorted(set(labels))
    model = zero_model(languages)
    k = len(languages)
    if not texts or k < 2:
        return model
    w = gathered(texts)
    if not w.n:
        return model
    index = {name: i for i, name in enumerate(languages)}
    label = np.array([index[x] for x in labels])[w.owner]
    rng = np.random.default_rng(seed)
    state = {name: np.full(model[name].shape, 1e-6, np.float32) for name in ("two", "three", "affix", "lexicon", "chain")}
    counts = np.diff(np.append(w.begin, len(w.two)))
    for _ in range(epochs):
        # Spans of 4 to 40 words in a random order make up the sequences.
        cuts = np.cumsum(rng.integers(4, 41, size=w.n // 4 + 1))
        cuts = np.unique(np.concatenate(([0], cuts[cuts < w.n], np.flatnonzero(np.diff(w.owner)) + 1, [w.n])))
        spans = rng.permutation(len(cuts) - 1)
        words = np.concatenate([np.arange(cuts[i], cuts[i + 1]) for i in spans])
        words = words[: len(words) // length * length] if len(words) >= length else np.resize(words, length)
        for at in range(0, len(words), batch * length):
            ids = words[at : at + batch * length]
            if len(ids) % length:
                ids = ids[: len(ids) // length * length]
            if not len(ids):
                continue
            places = np.repeat(w.begin[ids], counts[ids]) + (
                np.arange(counts[ids].sum()) - np.repeat(np.cumsum(counts[ids]) - counts[ids], counts[ids])
            )
            starts = np.concatenate(([0], np.cumsum(counts[ids])[:-1]))
            two, three = w.two[places], w.three[places]
            scores = (
                np.add.reduceat(model["two"][two] + model["three"][three], starts, axis=0)
                + model["affix"][w.affix[ids]].sum(axis=1)
                + model["lexicon"][w.lexicon[ids]]
            )
            marg, pairs = _pair_expectation(model, scores, length)
            gold = np.zeros_like(marg)
            gold[np.arange(len(ids)), label[ids]] = 1.0
            error = (marg - gold) / (len(ids) / length)
            seq = label[ids].reshape(-1, length)
            seen = np.zeros((k, k))
            np.add.at(seen, (seq[:, :-1].ravel(), seq[:, 1:].ravel()), 1.0)
            spread = np.repeat(error, counts[ids], axis=0)
            grads = {
                "two": (two, spread), "three": (three, spread), "lexicon": (w.lexicon[ids], error),
                "affix": (w.affix[ids].ravel(), np.repeat(error, 2, axis=0)),
            }
            for name, (place, err) in grads.items():
                size = len(model[name])
                g = np.stack([np.bincount(place, err[:, j], size) for j in range(k)], axis=1).astype(np.float32)
                g += l2 * model[name]
                state[name] += g * g
                model[name] -= rate * g / np.sqrt(state[name])
            g = ((pairs - seen) / (len(ids) / length)).astype(np.float32)
            state["chain"] += g * g
            model["chain"] -= 0.1 * g / np.sqrt(state["chain"])
    return model


def label_texts(model: dict, texts: list[str], piece: int = PIECE) -> np.ndarray:
    """Mean word marginals [texts, languages]; zero rows for texts without letters.

    Texts are worked on in groups of about ``piece`` characters: the arrays of a group take
    more than a hundred bytes a character, and an executor runs as many tasks as it has cores.
    """
    k = len(model["languages"])
    out = np.zeros((len(texts), k))
    start = 0
    while start < len(texts):
        stop, chars = start, 0
        while stop < len(texts) and (stop == start or chars + len(texts[stop]) <= piece):
            chars += len(texts[stop])
            stop += 1
        owners, scores = [], []
        parts = [(i, p) for i in range(start, stop) for p in _slices(texts[i], piece)]
        group: list[tuple[int, str]] = []
        for item in [*parts, None]:
            if item is not None:
                group.append(item)
            if group and (item is None or sum(len(p) for _, p in group) >= piece):
                w = Words([p for _, p in group])
                owners.append(np.array([i for i, _ in group], dtype=np.int64)[w.owner] if w.n else np.empty(0, np.int64))
                scores.append(emissions(model, w))
                group = []
        owner, score = np.concatenate(owners), np.concatenate(scores)
        bounds = np.searchsorted(owner, np.arange(start, stop + 1))
        marg = marginals(model, score, bounds)
        for j in range(k):
            out[start:stop, j] = np.bincount(owner - start, marg[:, j], stop - start)
        out[start:stop] /= np.maximum(np.diff(bounds), 1)[:, None]
        start = stop
    return out


def _slices(text: str, size: int) -> list[str]:
    """A very long text in parts that end at word borders."""
    parts, at = [], 0
    while len(text) - at > size:
        end = at + size
        while end < len(text) and text[end].isalpha():
            end += 1
        parts.append(text[at:end])
        at = end
    return [*parts, text[at:]]
