"""Figures of a text's words, signs and lines, for many texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexmill.llm._words import AFTER_DETERMINER, DETERMINERS, ENGLISH, FRENCH, GERMAN, ITALIAN, NOT_AFTER_PREPOSITION, PREPOSITIONS, PRONOMINAL, SPANISH, VERBAL
from lexmill.llm.spam import passages, word_bytes, word_hashes

#: Words on either side of a word that tell whether it stands in a running sentence.
REACH = 6
#: Words on either side over which the order of determiners, prepositions and what follows them is judged.
ORDER_REACH = 20

NAMES = (
    "words", "runs", "word_length", "function_share", "verbal_share", "near_share", "sentence_share", "clause_share", "sound_share", "broken_share", "symbol_share", "digit_share",
    "lines", "words_per_line", "ended_lines", "bullet_lines", "vowelless_share", "long_share", "distinct_share", "english_share", "german_share",
    "sentences", "letters", "syllables", "many_syllables", "long_words",
)

_VOWEL = np.isin(np.arange(256), [*b"aeiouy"])


def _in(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x


class Figures:
    """texts -> one array for each of NAMES. Texts without words have zeros throughout."""

    def __init__(self) -> None:
        self.all = word_hashes(sorted({*ENGLISH, *GERMAN, *FRENCH, *SPANISH, *ITALIAN}))
        self.determiners, self.prepositions = word_hashes(DETERMINERS), word_hashes(PREPOSITIONS)
        self.no_noun = word_hashes(sorted({*ENGLISH} - {*AFTER_DETERMINER}))
        self.linking = word_hashes(sorted({*ENGLISH, *GERMAN, *FRENCH, *SPANISH, *ITALIAN} - {*VERBAL, *PRONOMINAL}))
        self.no_object = word_hashes(NOT_AFTER_PREPOSITION)
        self.verbal, self.english, self.german = word_hashes(sorted(set(VERBAL))), word_hashes(ENGLISH), word_hashes(GERMAN)

    def __call__(self, texts: pa.Array) -> dict[str, np.ndarray]:
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            return self._figures(texts)

    def _figures(self, texts: pa.Array) -> dict[str, np.ndarray]:
        low = pc.fill_null(pc.utf8_lower(texts), "").cast(pa.large_string())
        n = len(low)
        bounds = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + n + 1]
        data = np.frombuffer(low.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        offsets = bounds - bounds[0]
        out = {k: np.zeros(n) for k in NAMES}
        if not len(data):
            return out
        data = _plain(data, offsets)
        p = passages(data, offsets)
        token, at, start, end = p["token"], p["at"], p["start"], p["end"]
        if not len(token):
            return out
        count = lambda mask=None: np.bincount(at, weights=mask, minlength=n)
        words = count().astype(float)
        share = lambda mask: np.divide(count(mask), words, out=np.zeros(n), where=words > 0)
        function, verbal = _in(self.all, token), _in(self.verbal, token)
        length = end - start
        first = np.searchsorted(at, np.arange(n))
        last = np.append(first[1:], len(at))
        here = np.arange(len(at))
        before, after = np.maximum(here - REACH, first[at]), np.minimum(here + REACH + 1, last[at])
        run = lambda x: np.concatenate([[0], np.cumsum(x)])
        f, v = run(function), run(verbal)
        width = after - before
        many = f[after] - f[before] >= 0.2 * width
        close_b, close_a = np.maximum(here - 2, first[at]), np.minimum(here + 3, last[at])
        vowels = run(_VOWEL[data] | (data >= 0x80))
        digits = run((data >= 48) & (data < 58))
        has_vowel = vowels[end] > vowels[start]
        has_digit = digits[end] > digits[start]
        syllables = self._syllables(data, start, end)
        clean = has_vowel & ~has_digit
        out["words"] = words
        plain = word_bytes(data) & (data != 95) & (data != 39)  # runs of letters or digits alone
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begins = plain.copy()
        begins[1:] &= ~plain[:-1] | edge[1:-1]
        out["word_length"] = share(length.astype(float))
        out["function_share"], out["verbal_share"] = share(function), share(verbal)
        out["near_share"] = share(f[close_a] > f[close_b])
        out["sentence_share"] = share(many)
        out["clause_share"] = share(many & (v[after] > v[before]))
        # "the of", "in was": words in no order of a sentence.
        follows = np.zeros(len(token), bool)
        follows[:-1] = at[1:] == at[:-1]
        after_token = np.append(token[1:], token[:1])
        determiner, preposition = _in(self.determiners, token) & follows, _in(self.prepositions, token) & follows
        broken = (determiner & _in(self.no_noun, after_token)) | (preposition & _in(self.no_object, after_token))
        called = determiner | preposition
        far_b, far_a = np.maximum(here - ORDER_REACH, first[at]), np.minimum(here + ORDER_REACH + 1, last[at])
        b, c, k = run(broken), run(called), run(_in(self.linking, token))
        sound = (b[far_a] - b[far_b] <= 0.15 * (c[far_a] - c[far_b])) & (k[far_a] - k[far_b] >= 0.06 * (far_a - far_b))
        out["sound_share"] = share(many & (v[after] > v[before]) & sound)
        out["broken_share"] = np.divide(count(broken), count(called), out=np.zeros(n), where=count(called) > 0)
        out["vowelless_share"] = share(~has_vowel | has_digit)
        out["long_share"] = share(length > 18)
        out["english_share"], out["german_share"] = share(_in(self.english, token)), share(_in(self.german, token))
        new = np.ones(len(token), bool)
        order = np.lexsort((token, at))
        new[1:] = (token[order][1:] != token[order][:-1]) | (at[order][1:] != at[order][:-1])
        out["distinct_share"] = np.divide(np.bincount(at[order], weights=new, minlength=n), words, out=np.zeros(n), where=words > 0)
        of = np.repeat(np.arange(n), np.diff(offsets))
        solid = ~np.isin(data, [9, 10, 11, 12, 13, 32])
        size = np.bincount(of, weights=solid, minlength=n)
        symbol = solid & (data < 0x80) & ~((data >= 48) & (data < 58)) & ~((data >= 97) & (data < 123)) & ~np.isin(data, [*b".,!?'\""])
        out["runs"] = np.bincount(of, weights=begins, minlength=n)
        part = lambda mask: np.divide(np.bincount(of, weights=mask, minlength=n), size, out=np.zeros(n), where=size > 0)
        out["symbol_share"] = part(symbol)
        out["digit_share"] = part((data >= 48) & (data < 58))
        self._lines(out, data, offsets, of, solid, words, n)
        out["sentences"] = np.bincount(p["seg_at"], minlength=n).astype(float)
        out["letters"] = count((length * clean).astype(float))
        out["syllables"] = count(syllables.astype(float))
        out["many_syllables"] = count((syllables >= 3).astype(float))
        out["long_words"] = count((length >= 7).astype(float))
        return out

    @staticmethod
    def _lines(out: dict, data: np.ndarray, offsets: np.ndarray, of: np.ndarray, solid: np.ndarray, words: np.ndarray, n: int) -> None:
        """Lines with at least one sign: how many end in punctuation, how many begin with a bullet, number or bar."""
        begin = np.zeros(len(data) + 1, bool)
        begin[offsets[:-1]] = True
        begin[1:] |= np.append(data[1:] * 0, 0).astype(bool) if len(data) == 0 else data == 10
        line = np.cumsum(begin[: len(data)])
        place = np.flatnonzero(solid)
        ids, first = np.unique(line[place], return_index=True)
        last = np.append(first[1:], len(place)) - 1
        whose = of[place[first]]
        lines = np.bincount(whose, minlength=n).astype(float)
        ended = np.isin(data[place[last]], [*b".!?"])
        lead = data[place[first]]
        bullet = np.isin(lead, [*b"-*+|#>=~"]) | (lead == 0xE2) | ((lead >= 48) & (lead < 58))
        out["lines"] = lines
        out["words_per_line"] = np.divide(words, lines, out=np.zeros(n), where=lines > 0)
        for key, mask in (("ended_lines", ended), ("bullet_lines", bullet)):
            out[key] = np.divide(np.bincount(whose, weights=mask, minlength=n), lines, out=np.zeros(n), where=lines > 0)

    @staticmethod
    def _syllables(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hyphenation-style count: vowel groups, less a mute final e (not -le), -es and -ed where they are mute; one at least."""
        vowel = _VOWEL[data] | (data == 0xC3)  # lead byte of accented letters
        opening = vowel.copy()
        opening[1:] &= ~vowel[:-1]
        sums = np.concatenate([[0], np.cumsum(opening)])
        groups = sums[end] - sums[start] + (vowel[start] & ~opening[start])
        length = end - start
        one, two, three = (data[np.maximum(end - k, 0)] for k in (1, 2, 3))
        mute = (one == ord("e")) & (length > 2) & ~_VOWEL[two] & ~((two == ord("l")) & ~_VOWEL[three])
        mute |= (one == ord("d")) & (two == ord("e")) & (length > 3) & ~_VOWEL[three] & ~np.isin(three, [*b"td"])
        mute |= (one == ord("s")) & (two == ord("e")) & (length > 3) & ~_VOWEL[three] & ~np.isin(three, [*b"scxzhgl"])
        return np.maximum(1, groups - mute)


def _plain(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Markup and entities blanked out, so that their names are no words; whole texts, whatever their length.

    A tag runs from < and a letter or / to the next >, unless another < comes first; where it holds blanks it must hold an
    = too or end in />, or it is text in angle brackets. An entity runs from & over letters, digits and # to a ; at once
    after them. Neither goes beyond its text.
    """
    out = data.copy()
    after = np.append(data[1:], 0)
    blanks, equals = (np.concatenate([[0], np.cumsum(x)]) for x in (np.isin(data, [9, 10, 13, 32]), data == 61))
    for sign, close in ((60, 62), (38, 59)):
        tag = sign == 60
        opens = np.flatnonzero((data == sign) & ((after == 47) | ((after >= 97) & (after < 123)) if tag else _NAME[after]))
        ends = np.flatnonzero((data == close) | (data == sign) if tag else ~_NAME[data])
        k = np.searchsorted(ends, opens, side="right")
        ok = k < len(ends)
        opens = opens[ok]
        until = ends[k[ok]]
        closed = (data[until] == close) & (np.searchsorted(offsets, opens, side="right") == np.searchsorted(offsets, until, side="right"))
        if tag:
            closed &= (blanks[until] == blanks[opens]) | (equals[until] > equals[opens]) | (data[until - 1] == 47)
        steps = np.zeros(len(data) + 1, np.int32)
        np.add.at(steps, opens[closed], 1)
        np.add.at(steps, until[closed] + 1, -1)
        out[np.cumsum(steps[:-1]) > 0] = 32
    return out


_NAME = np.isin(np.arange(256), [*range(48, 58), *range(97, 123), 35])
