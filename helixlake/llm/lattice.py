"""Noisy-channel restoration of disguised words.

The channel turns letters into look-alike digits and signs, masks them, repeats them, spaces them out or mistypes one of them.  For an
observed token every character stands for a set of letters with costs; together they form a lattice.  The character language model is
a prefix model of the lexicon, P(letter | letters so far), held as a trie; a letter-bigram model of ordinary words is the rival
hypothesis that the token is what it looks like.  Viterbi search over (position, trie node, mistakes so far) finds the likeliest word,
and the token is restored only if that beats the rival.
"""

from __future__ import annotations

import math
import re

# What a look-alike character may stand for.
LOOKALIKE = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "|": "il", "€": "e", "!": "i", "+": "t", "(": "c", "<": "c",
}
# Cyrillic and Greek letters drawn like Latin ones.
HOMOGLYPHS = str.maketrans("аеорсухіјѕԁькмтвнгАЕОРСУХІЈЅВНКМТοαικνρτυχ", "aeopcyxijsdbkmtbhrAEOPCYXIJSBHKMToaikvptux")
MASK = "*#"

LOOKS, MASKED, REPEAT, TYPO, FOLDED = 0.7, 1.2, 0.15, 4.0, 0.3
#: Letters spaced out by one and the same separator.
SPACED = re.compile(r"(?<![\w@$*])[\w@$*](?:([ .\-_])[\w@$*])(?:\1[\w@$*])+(?![\w@$*])")
_RUN, _LONG_RUN = re.compile(r"(.)\1+", re.S), re.compile(r"(.)\1{3,}", re.S)
_ACCENT = dict(zip("áàâäãåéèêëíìîïóòôöõúùûüñç", "aaaaaaeeeeiiiiooooouuuunc", strict=True))


class Restorer:
    """Restores tokens to words of ``lexicon`` (word: weight); ``ordinary`` words train the rival letter model."""

    def __init__(self, lexicon: dict[str, float], ordinary: dict[str, float]) -> None:
        self.child: list[dict[str, int]] = [{}]
        self.mass: list[float] = [0.0]
        self.word: dict[int, tuple[str, float]] = {}
        for w, k in lexicon.items():
            v = 0
            self.mass[0] += k
            for ch in w:
                nxt = self.child[v].get(ch)
                if nxt is None:
                    nxt = self.child[v][ch] = len(self.child)
                    self.child.append({})
                    self.mass.append(0.0)
                v = nxt
                self.mass[v] += k
            self.word[v] = (w, k)
        self.lexicon = lexicon
        pairs: dict[str, float] = {}
        ones: dict[str, float] = {}
        for w, k in ordinary.items():
            t = f"^{w}$"
            for a, b in zip(t, t[1:], strict=False):
                pairs[a + b] = pairs.get(a + b, 0) + k
                ones[a] = ones.get(a, 0) + k
        self.pairs, self.ones = pairs, ones
        #: Every word and every word short of one letter: a token within one mistake shares one of them.
        self.near = {s for w in lexicon if len(w) >= 5 for s in (w, *(w[:i] + w[i + 1 :] for i in range(len(w))))}
        #: Words with repeated letters written once, and the most characters that a word can be stretched to (runs count as three).
        self.squeezed = {_RUN.sub(r"\1", w) for w in lexicon}
        self.longest = 3 * max(map(len, lexicon), default=0) + 2
        self.memo: dict[str, str | None] = {}

    def restore(self, token: str) -> str | None:
        """The lexicon word behind a lower-case token, or None."""
        if token in self.lexicon:
            return token
        if token not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[token] = self._restore(token)
        return self.memo[token]

    def _restore(self, token: str) -> str | None:
        token = _LONG_RUN.sub(r"\1\1\1", token)
        if not 3 <= len(token) <= self.longest:
            return None
        plain = token.isalpha()
        if plain and not any(a == b == c for a, b, c in zip(token, token[1:], token[2:], strict=False)) and _RUN.sub(r"\1", token) not in self.squeezed:
            if not (token in self.near or any(token[:i] + token[i + 1 :] in self.near for i in range(len(token)))):
                return None
        elif not plain and (token.isdigit() or sum(c.isalpha() or c in LOOKALIKE for c in token) < 2):
            return None
        best = self.viterbi(token)
        return best[0] if best and best[1] < self.rival(token) else None

    def rival(self, token: str) -> float:
        """Cost of the token as an ordinary word."""
        t, cost = f"^{token}$", 0.0
        for a, b in zip(t, t[1:], strict=False):
            cost -= math.log((self.pairs.get(a + b, 0) + 0.05) / (self.ones.get(a, 0) + 3.0))
        return cost

    def _letters(self, ch: str) -> list[tuple[str, float]]:
        out = [(ch, 0.0)] if ch.isalpha() else []
        if ch in LOOKALIKE:
            out += [(x, LOOKS) for x in LOOKALIKE[ch]]
        if ch in _ACCENT:
            out.append((_ACCENT[ch], FOLDED))
        return out

    def viterbi(self, token: str, mistakes: int = 1) -> tuple[str, float] | None:
        """The cheapest word and its cost: channel costs minus the log probability of its letters."""
        child, mass, n = self.child, self.mass, len(token)
        if not mass[0]:
            return None
        allowed = mistakes if n >= 4 else 0
        layers: list[dict[tuple[int, int, str], float]] = [{} for _ in range(n + 1)]
        layers[0][0, 0, ""] = 0.0

        def put(i: int, key: tuple[int, int, str], cost: float) -> None:
            if cost < layers[i].get(key, 1e9):
                layers[i][key] = cost

        for i in range(n):
            ch = token[i]
            letters = self._letters(ch)
            queue = list(layers[i].items())
            for (v, m, last), cost in queue:
                follow = child[v]
                for x, c in letters:
                    if (u := follow.get(x)) is not None:
                        put(i + 1, (u, m, ch), cost + c - math.log(mass[u] / mass[v]))
                    if x in "aeiounc" and c == 0.0:
                        for y, base in _ACCENT.items():
                            if base == x and (u := follow.get(y)) is not None:
                                put(i + 1, (u, m, ch), cost + FOLDED - math.log(mass[u] / mass[v]))
                if ch in MASK:
                    for u in follow.values():
                        put(i + 1, (u, m, ch), cost + MASKED - math.log(mass[u] / mass[v]))
                if ch == last:
                    put(i + 1, (v, m, ch), cost + REPEAT)
                if m < allowed and v:
                    put(i + 1, (v, m + 1, last), cost + TYPO)  # a letter too many
                    for x, u in follow.items():
                        step = cost + TYPO - math.log(mass[u] / mass[v])
                        for y, c in letters:  # a letter left out
                            if (t := child[u].get(y)) is not None:
                                put(i + 1, (t, m + 1, ch), step + c - math.log(mass[t] / mass[u]))
                        if i + 1 < n and (x, 0.0) in self._letters(token[i + 1]):  # two letters exchanged
                            for y, c in letters:
                                if (t := child[u].get(y)) is not None:
                                    put(i + 2, (t, m + 1, token[i + 1]), step + c - math.log(mass[t] / mass[u]))
        best: tuple[str, float] | None = None
        for (v, m, _), cost in layers[n].items():
            ends = [(v, cost)] + [(u, cost + TYPO - math.log(mass[u] / mass[v])) for u in child[v].values() if m < allowed]
            for u, c in ends:
                if u in self.word:
                    w, k = self.word[u]
                    c -= math.log(k / mass[u])
                    if best is None or (c, w) < (best[1], best[0]):
                        best = w, c
        return best


def _joined(m: re.Match) -> str:
    word = m.group()[::2]
    letters = sum(c.isalpha() for c in word)
    return word if letters >= 3 or letters == 2 and word[0].isalpha() and word[-1].isalpha() else m.group()


def join_spaced(text: str) -> str:
    """``i d i o t`` and ``i-d-i-o-t`` as ``idiot``; runs of fewer than three characters, and numbers, stay."""
    return SPACED.sub(_joined, text)
