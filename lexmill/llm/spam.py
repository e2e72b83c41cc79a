"""Problem 9: keyword-stuffed and link-list pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm._minhash import BASE, POWERS, U, mixed, portions
from lexmill.llm._words import ENGLISH, GERMAN
from lexmill.session import stored

#: A page stuffs a phrase that it holds at least so often and that makes at least so much of its words.
STUFFED_TIMES, STUFFED_SHARE = 4, 0.06
#: Its surroundings change: a sentence said over and over keeps its phrases between the same words.
SURROUNDINGS = 3
#: A search phrase is stuffed by at least so many hosts, and by at least half of those that repeat it.
HOSTS = 3
#: A passage with fewer function words than this share is an entry of a list, not a sentence.
FEW_FUNCTION_WORDS = 0.1
#: Common ends of host names: they mark an address without a scheme even where no path follows. Fixed values.
ENDINGS = (b"com", b"org", b"net", b"info", b"edu", b"gov", b"de", b"at", b"ch", b"uk", b"eu", b"io")
MONEY = (b"eur", b"usd", b"gbp", b"$", "€".encode(), "£".encode())
#: Search phrases up to this number are broadcast (8 bytes each, some 64 in a hashed relation: 20 MB); more are joined by shuffle.
BROADCAST_PHRASES = 300_000

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), 95, 39, *range(0xC3, 0x100), *range(0x80, 0xC0)]] = True
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_DIGIT = np.isin(np.arange(256), range(48, 58))
_ALNUM = np.isin(np.arange(256), [*range(48, 58), *range(97, 123)])


def _shift(x: np.ndarray, by: int) -> np.ndarray:
    """x moved so that place i holds what stood at i + by; zeros where there is nothing."""
    out = np.zeros_like(x)
    if by > 0:
        out[:-by] = x[by:]
    else:
        out[-by:] = x[:by]
    return out


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = POWERS.upto(len(data) + 1)
    sums = np.empty(len(data) + 1, U)
    sums[0] = 0
    np.cumsum((data.astype(U) + U(1)) * up[:-1], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def word_hashes(words: list[str]) -> np.ndarray:
    encoded = [w.encode() for w in words]
    ends = np.cumsum([len(x) for x in encoded])
    with np.errstate(over="ignore"):
        return np.unique(hash_ranges(np.frombuffer(b"".join(encoded), np.uint8), ends - [len(x) for x in encoded], ends))


def word_bytes(data: np.ndarray) -> np.ndarray:
    """Whether each byte belongs to a word: ASCII letters, digits, _ and ', and all letters beyond ASCII."""
    odd = (data == 0xC2) | (data == 0xE2)  # signs and spaces beyond ASCII; letters have other lead bytes
    odd |= _shift(odd, -1) | _shift(data == 0xE2, -2)
    return _WORD[data] & ~odd


def passages(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Words and passages (sentences, lines) of lower-cased texts that lie end to end in data.

    token, at, seg: hash of each word, its text and its passage; marked: for each passage, whether it holds an address, a
    link label, a price or an article number.
    """
    n, texts = len(data), len(offsets) - 1
    word = word_bytes(data)
    inner = np.zeros(n + 1, bool)
    inner[offsets] = True  # texts do not run together
    starts = np.flatnonzero(word & (~_shift(word, -1) | inner[:n]))
    ends = np.flatnonzero(word & (~_shift(word, 1) | inner[1:])) + 1
    after = _shift(data, 1)
    stop = (data == 10) | (np.isin(data, [33, 46, 63]) & _SPACE[after])
    stop |= (data == 60) & np.isin(after, [47, 98, 100, 108, 112])  # </ <b <d <l <p
    stop |= inner[:n]
    part = np.cumsum(stop)
    seg = part[starts]
    at = np.searchsorted(offsets, starts, side="right") - 1
    two = _shift(data, 2)
    links = (data == 58) & (after == 47) & (two == 47)
    links |= (data == 60) & (after == 97) & (two == 32)
    links |= (data == 62) & (after == 62)
    links |= (data == 0xC2) & (after == 0xBB)
    before = _shift(data, -1)
    found = [np.flatnonzero(links)]
    raw = data.tobytes()
    breaks = np.append(np.flatnonzero(~_ALNUM[data]), n)
    outer = np.append(np.flatnonzero(~(_ALNUM[data] | (data == 45) | (data == 46))), n)
    dots = np.flatnonzero((data == 46) & _ALNUM[before] & _ALNUM[after])
    for i, end, close in zip(dots, breaks[np.searchsorted(breaks, dots, side="right")], np.searchsorted(outer, dots)):
        # "name.end/path", "www.name", a name of three parts, a dotted name alone in brackets, or a known end: a full stop
        # without a blank behind it has none of them.
        low, high = outer[close - 1] + 1 if close else 0, outer[close]
        parts = raw[low:high].strip(b".-").split(b".")
        named = all(len(x) > 1 and not x.isdigit() for x in parts)
        bracketed = low > 0 and raw[low - 1 : low] in (b"(", b"[", b"<") and raw[high : high + 1] in (b")", b"]", b">")
        if named and (len(parts) > 2 or bracketed or raw[end : end + 1] == b"/" or raw[i + 1 : end] in ENDINGS) or raw[i - 3 : i] == b"www":
            found.append(np.array([i]))
    digits = np.append(np.flatnonzero(~_DIGIT[data]), n)
    cents = np.flatnonzero(((data == 44) | (data == 46)) & _DIGIT[before] & _DIGIT[after] & _DIGIT[two])
    for i, end in zip(cents, digits[np.searchsorted(digits, cents, side="right")]):
        if raw[end : end + 4].lstrip(b" ").startswith(MONEY) or raw[max(0, digits[np.searchsorted(digits, i) - 1] - 4) : i].rstrip(b"0123456789").rstrip(b" ").endswith(MONEY):
            found.append(np.array([i]))
    found.append(np.flatnonzero((data == 45) & (before >= 97) & (before < 123) & _DIGIT[after] & _DIGIT[two] & _DIGIT[_shift(data, 3)]))
    marked = np.unique(part[np.concatenate(found)])
    first = np.ones(len(seg), bool)
    first[1:] = seg[1:] != seg[:-1]
    return {"token": hash_ranges(data, starts, ends), "at": at, "seg": seg, "marked": marked, "start": starts, "end": ends, "seg_at": at[first]}


def phrase_rows(texts: pa.Array, function_words: np.ndarray) -> list[pa.Array]:
    """Of each text: words, words of list entries and links, its distinct phrases and their counts, and where they occur."""
    low = pc.fill_null(pc.utf8_lower(texts), "").cast(pa.large_string())
    bounds = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    data = np.frombuffer(low.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    offsets = bounds - bounds[0]
    count = len(low)
    empty = [pa.array(np.zeros(count, np.int32))] * 2 + [pa.array([[]] * count, t) for t in (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))]
    if not len(data):
        return empty
    p = passages(data, offsets)
    token, at, seg = p["token"], p["at"], p["seg"]
    if not len(token):
        return empty
    ids, seg = np.unique(seg, return_inverse=True)
    function = np.isin(token, function_words)
    size = np.bincount(seg)
    listed = np.isin(ids, p["marked"]) | (np.bincount(seg, weights=function) < FEW_FUNCTION_WORDS * size)
    words = np.bincount(at, minlength=count)
    entries = np.bincount(at, weights=listed[seg], minlength=count)
    pair = np.flatnonzero((seg[1:] == seg[:-1]) & ~function[1:] & ~function[:-1])
    bound = np.flatnonzero((seg[2:] == seg[:-2]) & ~function[2:] & function[1:-1] & ~function[:-2])
    phrase = np.concatenate([mixed(token[pair] * U(BASE) + token[pair + 1]), mixed((token[bound] * U(BASE) + token[bound + 1]) * U(BASE) + token[bound + 2])])
    last = np.concatenate([pair + 1, bound + 2])
    pair = np.concatenate([pair, bound])
    where, place = at[pair], seg[pair]
    before, after = np.maximum(pair - 1, 0), np.minimum(last + 1, len(token) - 1)
    around = np.where((before < pair) & (at[before] == where), token[before], U(0)) * U(BASE) + np.where((after > last) & (at[after] == where), token[after], U(0))
    order = np.lexsort((around, phrase, where))
    key = np.stack([where[order].astype(U), phrase[order], around[order]])
    group = np.cumsum(np.append(np.ones(min(1, len(order)), bool), (key[:2, 1:] != key[:2, :-1]).any(axis=0))) - 1
    varied = np.bincount(group[np.append(np.ones(min(1, len(order)), bool), (key[:, 1:] != key[:, :-1]).any(axis=0))])
    order = np.lexsort((place, phrase, where))
    phrase, where, place = phrase[order], where[order], place[order]
    new = np.ones(len(phrase), bool)
    new[1:] = (phrase[1:] != phrase[:-1]) | (where[1:] != where[:-1])
    group = np.cumsum(new) - 1
    times = np.bincount(group)
    first = np.flatnonzero(new)
    fresh = new.copy()
    fresh[1:] |= place[1:] != place[:-1]
    fresh &= ~listed[place]
    lists = lambda of, *values: [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=count))]).astype(np.int32)), pa.array(v)) for v in values]
    return [
        pa.array(words.astype(np.int32)), pa.array(entries.astype(np.int32)),
        *lists(where[first], phrase[first].view(np.int64), times.astype(np.int32), varied.astype(np.int32)),
        *lists(where[fresh], phrase[fresh].view(np.int64), place[fresh].astype(np.int32), size[place[fresh]].astype(np.int32)),
    ]


def page_evidence(pages: DataFrame, key: str = "doc_id", text: str = "text", host: str = "author_key") -> DataFrame:
    """(doc_id, host, words, entries, phrases, counts, varied, at_phrase, at_seg, at_words) of each page, whole texts, in one pass.

    Phrase shingles are two content words of one passage, side by side or around one function word ("notebook and pen");
    all of a page are kept, those it holds once as well.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        function_words = word_hashes(ENGLISH + GERMAN)
        for batch in batches:
            for low, high in portions(batch.column(2)):
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *phrase_rows(part.column(2), function_words)], names=names)

    rows = pages.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(host).cast("string"), F.concat(F.lit("page "), F.col(key).cast("string")))).alias("host"), F.col(text)
    )
    schema = "doc_id long, host long, words int, entries int, phrases array<long>, counts array<int>, varied array<int>, at_phrase array<long>, at_seg array<int>, at_words array<int>"
    names = [x.split()[0] for x in schema.split(", ")]
    return rows.mapInArrow(look, schema)


def search_phrases(evidence: DataFrame) -> DataFrame:
    """page_evidence() to (phrase, hosts, stuffing, repeating): phrases replicated over hosts to be found.

    All phrases of all pages are exploded and counted over distinct hosts, a host's pages being one. A search phrase is
    replicated: HOSTS hosts or more stuff it, and so do at least half of those that repeat it on a page. Repetition is
    evidence here, no filter: hosts that hold a phrase once count in `hosts`, and their passages are looked at like all others.
    """
    held = evidence.select("host", "words", F.explode(F.arrays_zip("phrases", "counts", "varied")).alias("x"))
    stuffed = (F.col("x.counts") >= STUFFED_TIMES) & (F.col("x.varied") >= SURROUNDINGS) & (2 * F.col("x.counts") >= STUFFED_SHARE * F.col("words"))
    rows = held.select("host", F.col("x.phrases").alias("phrase"), stuffed.cast("int").alias("stuffed"), (F.col("x.counts") > 1).cast("int").alias("repeated"))
    by_host = rows.groupBy("phrase", "host").agg(F.max("stuffed").alias("stuffed"), F.max("repeated").alias("repeated"))
    phrases = by_host.groupBy("phrase").agg(F.count("*").alias("hosts"), F.sum("stuffed").alias("stuffing"), F.sum("repeated").alias("repeating"))
    return phrases.where((F.col("stuffing") >= HOSTS) & (2 * F.col("stuffing") >= F.col("repeating")))


def spam_pages(pages: DataFrame, key: str = "doc_id", text: str = "text", host: str = "author_key", share: float = 0.5) -> DataFrame:
    """pages to (doc_id, words, spam_words, is_spam): pages more than `share` of which is stitched from search phrases, links and list entries.

    A host is an author, or the page itself where none is known. The words of passages that hold a search phrase, though it
    stand once on the page, are joined with those of list-like passages: addresses, link labels, prices, article numbers, or
    hardly any function word. Null texts give no row; texts without words give zeros; a repeated id gives the row of its
    wordiest text.
    """
    evidence = stored(page_evidence(pages, key, text, host))
    search = stored(search_phrases(evidence).select("phrase"))
    search = F.broadcast(search) if search.count() <= BROADCAST_PHRASES else search.hint("merge")
    hits = evidence.select("doc_id", F.explode(F.arrays_zip("at_phrase", "at_seg", "at_words")).alias("x")).select(
        "doc_id", F.col("x.at_phrase").alias("phrase"), F.col("x.at_seg").alias("seg"), F.col("x.at_words").alias("n")
    )
    hits = hits.join(search, "phrase", "left_semi").groupBy("doc_id", "seg").agg(F.max("n").alias("n"))
    hits = hits.groupBy("doc_id").agg(F.sum("n").alias("_hits"))
    sums = evidence.select("doc_id", "words", "entries").groupBy("doc_id").agg(F.max_by("entries", "words").alias("entries"), F.max("words").alias("words"))
    spam = (F.col("entries") + F.coalesce("_hits", F.lit(0))).cast("int")
    return sums.join(hits, "doc_id", "left").select("doc_id", "words", spam.alias("spam_words"), ((F.col("words") > 0) & (spam > share * F.col("words"))).alias("is_spam"))
