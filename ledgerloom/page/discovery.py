"""Labels and values of whole pages. A page is one row of arrays, so that its tokens travel with it and meet nothing by a shuffle.

Scores and regions are those of ``functions.labels``, number by number. A page's phrases meet an alias by bits of shared words, or
by a piece of it that few edits must leave whole; a bound of the score leaves few of them to be scored.
"""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache, reduce
from itertools import combinations
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ledgerloom.functions.labels import FIELD_SPECS, GENERIC_LABELS, PRIOR_KINDS
from ledgerloom.functions.text import OCR_DIGITS, OCR_LETTERS
from ledgerloom.page.rows import rows_of_page

FOUND = "array<struct<field:string,kind:string,critical:boolean,score:double,lines:array<string>>>"
LONGEST = 4
PAGES = 256
"""Pages that are taken at a time."""
_SWAP = str.maketrans(OCR_DIGITS, OCR_LETTERS)
_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


def ocr(s: str) -> str:
    """``functions.text.ocr_text`` of a string."""
    return re.sub("[^a-z0-9]+", " ", s.lower().translate(_SWAP)).strip(" ")


@lru_cache(1_000)
def _places(a: str) -> dict[str, int]:
    return {c: sum(1 << i for i, x in enumerate(a) if x == c) for c in set(a)}


def edits(a: str, b: str) -> int:
    """The edit distance of two texts, a column of it in the bits of a number (Myers)."""
    if not a or not b:
        return len(a) + len(b)
    at, whole, top = _places(a), (1 << len(a)) - 1, 1 << (len(a) - 1)
    more, less, n = whole, 0, len(a)
    for c in b:
        eq = at.get(c, 0)
        xv, xh = eq | less, (((eq & more) + more) ^ more) | eq
        up, down = (less | ~(xh | more)) & whole, more & xh
        n += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & whole, (down << 1) & whole
        more, less = (down | ~(xv | up)) & whole, up & xv
    return n


def n_words(s: str) -> int:
    return sum(w != "" for w in _SPACE.split(s))


@lru_cache(200_000)
def placeless(phrase: str, alias: str, field: str) -> float | None:
    """``functions.labels.label_score`` before its terms of place; None if it is 0 wherever it stands, or if the two do not meet."""
    p, a = ocr(phrase), ocr(alias)
    name = re.sub("[^a-z0-9]+", "", field.lower())
    if not p or not a or (name == "tax" and "tax id" in p):
        return None
    pw, aw = p.split(" "), a.split(" ")
    apart = edits(p, a)
    if not set(pw) & set(aw) and not (len(a) >= 7 and abs(len(p) - len(a)) <= 3 and apart <= 3):
        return None
    likeness = 1.0 - apart / max(len(p), len(a))
    shared, ordered = len(set(pw) & set(aw)) / len(set(aw)), sum(x == y for x, y in zip(pw, aw, strict=False)) / len(aw)
    extra = n_words(phrase) - n_words(alias)
    low, alias_low = phrase.lower(), alias.lower()
    numbered = lambda s: any(x in s for x in ("#", "no", "number"))
    total = likeness * 0.55 + shared * 0.20 + ordered * 0.12
    total += 0.15 if p == a else 0.08 if p.startswith(a) or a.startswith(p) else 0.0
    total += 0.05 if phrase.strip(" ").endswith(":") else 0.0
    total += -min(0.18, extra * 0.05) if extra > 2 else 0.0
    total += -min(0.26, -extra * 0.12) if extra < 0 else 0.0
    total += -0.5 if numbered(alias_low) and not numbered(low) else 0.0
    total += -0.85 if name == "invoicedate" and "due" in p else 0.0
    total += 0.22 if name == "invoicedate" and "issue" in p else 0.0
    total += -0.3 if name == "duedate" and "invoice" in p else 0.0
    total += -0.4 if name == "duedate" and "issue" in p else 0.0
    total += -0.2 if " to" in alias_low and " to" not in low and not low.endswith("to:") else 0.0
    return total + (-0.18 if p in GENERIC_LABELS and a not in (p, f"invoice {p}") else 0.0)


def placed(total: float, field: str, cx: float, cy: float) -> float:
    kind = PRIOR_KINDS.get(re.sub("[^a-z0-9]+", "", field.lower()))
    total += 0.05 if cx < 0.55 else 0.0
    if kind in ("invoice_number", "invoice_date", "due_date"):
        total += (0.08 if cx > 0.45 else 0.05) if cy < 0.35 else -0.03
    elif kind:
        total += (0.08 if cx > 0.4 else 0.04) if cy > 0.5 else -0.03
    return min(total, 1.0)


@lru_cache(100_000)
def region(x: int, y: int, w: int, h: int, page_w: int, page_h: int, below: bool, address: bool) -> tuple[float, float, float, float]:
    """``functions.labels.value_region`` as left, top, right and bottom."""
    gap_x, gap_y = max(int(page_w * 0.01 // 1), 6), max(int(page_h * 0.01 // 1), 6)
    bx = max(x - gap_x, 0) if below else min(page_w - 1, x + w + gap_x)
    by = min(page_h - 1, y + h + gap_y) if below else max(y - int(h * 0.25 // 1), 0)
    bw = min(int(page_w * 0.45 // 1), page_w - bx)
    bh = min(int(h * (4.0 if below else 1.6 if address else 1.8) // 1), page_h - by)
    bw = max(bw, min(int(page_w * 0.08 // 1), max(page_w - bx, 1)))
    bh = max(bh, min(int(page_h * 0.03 // 1), max(page_h - by, 1)))
    left, top = bx / page_w, by / page_h
    six = lambda v: float(Decimal(repr(v)).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return six(left), six(top), six(left) + six(min(bw / page_w, 1.0 - left)), six(top) + six(min(bh / page_h, 1.0 - top))


def rows_of_pages(centre: np.ndarray, height: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``rows_of_page`` of each page. Where rows are apart by more than the reach and no wider than it, the means need not be followed."""
    some = counts > 0
    starts = (np.cumsum(counts) - counts)[some]
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    low, high = np.minimum.reduceat(height, starts), np.maximum.reduceat(height, starts)
    reach = np.maximum(4.0, np.maximum(low, 1) * 1.5)
    of = np.repeat(np.arange(len(starts)), counts[some])
    new = np.ones(len(centre), dtype=bool)
    new[1:] = np.diff(centre) > reach[of[1:]] + 1e-6
    new[starts] = True
    row = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    wide = centre[np.append(first[1:], len(centre)) - 1] - centre[first] > reach[of[first]] - 1e-6
    out = row - row[starts][of]
    for k in np.flatnonzero((low != high) | (np.bincount(of[first], wide, minlength=len(starts)) > 0)).tolist():
        at = slice(starts[k], starts[k] + counts[some][k])
        out[at] = rows_of_page(centre[at], height[at])
    return out


def sorted_by(*keys: np.ndarray) -> np.ndarray:
    """The order by whole numbers, the first key first; as one number where their ranges allow."""
    one, room = np.zeros(len(keys[0]), dtype=np.int64), 1
    for k in keys if len(one) else ():
        least, span = int(k.min()), int(k.max()) - int(k.min()) + 1
        room *= span
        if room >= 1 << 62:
            return np.lexsort(keys[::-1])
        one = one * span + (k - least)
    return np.arange(len(one)) if (np.diff(one) >= 0).all() else np.argsort(one, kind="stable")


def left_whole(alias: str, most: int) -> list[str]:
    """Pieces of which one is within a word of every text that is so many edits from the alias at most, and shares no word with it.

    Of two words, one edit breaks both only where they meet, and leaves both whole; two edits in one of them leave the other a word, so
    the longer has one at most. Else the alias is cut into one more piece than edits, so that the shortest is as long as can be.
    """
    longest = max(alias.split(" "), key=len)
    two = alias.count(" ") == 1
    if not most or two and most == 1:
        return [longest] * most
    if two and most == 2:
        return [longest[: len(longest) // 2], longest[len(longest) // 2 :]]
    cut = lambda at: [max(alias[a:b].split(" "), key=len) for a, b in zip((0, *at), (*at, len(alias)), strict=True)]
    return max(map(cut, combinations(range(1, len(alias)), most)), key=lambda pieces: (min(map(len, pieces)), sum(map(len, pieces))))


class Finder:
    """The aliases by bits of their words and pieces, and what is known of the tokens at hand."""

    def __init__(self, floor: float):
        self.floor = floor
        self.aliases = [(f, kind, at == "below", critical, a) for f, (kind, at, critical, names) in FIELD_SPECS.items() for a in names]
        texts = [ocr(x[4]) for x in self.aliases]
        self.words = {w: k for k, w in enumerate(sorted({w for t in texts for w in t.split(" ")}))}
        if len(self.words) > 64 or len(texts) > 64:
            raise ValueError("aliases and their words must fit 64 bits")
        self.pieces: dict[str, int] = {}
        self.known = []
        for k, (t, x) in enumerate(zip(texts, self.aliases, strict=True)):
            most = max((e for e in (1, 2, 3) if len(t) >= 7 and 0.55 * (1 - e / (len(t) + e)) + 0.26 >= floor - 1e-9), default=0)  # edits that a score without a shared word can bear
            for f in left_whole(t, most):
                self.pieces[f] = self.pieces.get(f, 0) | 1 << k
            if x[0] == "invoiceDate" and len(t) >= 7:
                self.pieces["issue"] = self.pieces.get("issue", 0) | 1 << k
            mask = sum(1 << self.words[w] for w in set(t.split(" ")))
            self.known.append((np.uint64(mask), self.bags_of(pa.array([t]))[0], len(t), len(set(t.split(" "))), n_words(x[4]), 0.08 if x[0].lower() in PRIOR_KINDS else 0.0, 0.22 if x[0] == "invoiceDate" else 0.0, 0.5 if re.search("#|no|number", x[4]) else 0.0, 0.2 if " to" in x[4] else 0.0))
        self.any_piece = "|".join(sorted(self.pieces))
        self.any_word = "(^| )(" + "|".join(self.words) + ")( |$)"
        self.seen: dict[str, tuple[int, int]] = {}  # words and pieces of aliases in a token

    @staticmethod
    def bags_of(texts: pa.Array) -> np.ndarray:
        offsets, data = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1], texts.buffers()[2]
        codes = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]].astype(np.int64) if data is not None else np.zeros(0, dtype=np.int64)
        at = np.where(codes == 32, 36, np.where(codes >= 97, codes - 97, codes - 22))
        of = np.repeat(np.arange(len(texts)), np.diff(offsets))
        return np.bincount(of * 37 + at, minlength=37 * len(texts)).clip(max=255).astype(np.uint8).reshape(-1, 37)

    def codes(self, texts: pa.Array) -> np.ndarray:
        """Each text's row in the tables, which hold these texts only."""
        found = texts.dictionary_encode(null_encoding="encode")
        raw = pc.fill_null(found.dictionary.cast(pa.string()), "")
        low = pc.utf8_lower(pc.replace_substring(raw, "\u0130", "i\u0307"))  # the one letter of which Java makes two
        plain = low
        for digit, letter in zip(OCR_DIGITS, OCR_LETTERS, strict=True):
            plain = pc.replace_substring(plain, digit, letter)
        plain = pc.utf8_trim(pc.replace_substring_regex(plain, "[^a-z0-9]+", " "), " ")
        has = lambda x, what: pc.match_substring_regex(x, what).to_numpy(zero_copy_only=False)
        size = pc.binary_length(plain).to_numpy()
        self.table = np.stack([size, size > 0, pc.count_substring_regex(raw, r"[^ \t\n\x0b\f\r]+").to_numpy(), has(raw, ": *$"), has(plain, "issue"), has(low, "#|no|number"), has(low, "to")], axis=1).astype(np.int32)
        self.masks = np.zeros((len(raw), 2), dtype=np.uint64)
        hit = np.flatnonzero(has(plain, self.any_word) | has(plain, self.any_piece))
        for k, t in zip(hit.tolist(), plain.take(pa.array(hit)).to_pylist(), strict=True):
            if t not in self.seen:
                if len(self.seen) > 300_000:
                    self.seen.clear()
                self.seen[t] = sum(1 << self.words[w] for w in set(t.split(" ")) if w in self.words), reduce(or_, (m for x, m in self.pieces.items() if x in t), 0)
            self.masks[k] = self.seen[t]
        self.bags = self.bags_of(plain)
        return found.indices.to_numpy()

    def candidates(self, code: np.ndarray, group: np.ndarray, cx: np.ndarray, cy: np.ndarray):
        """(start, n, alias, bound) of the phrases that may score the floor; ``group`` numbers the rows of all pages, ``cx`` and ``cy`` are the tokens' left and top."""
        out = []  # of a token the tables have its length, whether any, words of the raw text, whether it ends with a colon and has issue, a number's sign or to
        masks = self.masks[code]
        for n in range(1, LONGEST + 1):
            k = len(code) - n + 1
            if k <= 0:
                break
            if n > 1:
                masks = masks[:k] | self.masks[code[n - 1 :]]
            hit = np.flatnonzero((masks[:, 0] | masks[:, 1]).astype(bool) & (group[n - 1 :] == group[:k]))
            if not len(hit):
                continue
            total = self.table[code[hit]]
            for i in range(1, n):
                total = total + self.table[code[hit + i]]
            size, raw, (words, pieces) = (total[:, 0] + total[:, 1] - 1).astype(np.int64), total[:, 2], np.ascontiguousarray(masks[hit].T)
            marks = total[:, 4:] > 0
            colon = self.table[code[hit + n - 1], 3] * 0.05
            colon[self.table[code[hit + n - 1], 2] == 0] = 0.05  # an empty last token may hide it
            for j, (mask, bag, la, aw, ar, prior, issue, numbered, to) in enumerate(self.known):
                met = words & mask
                at = np.flatnonzero(met | (pieces & np.uint64(1 << j)))
                if not len(at):
                    continue
                shared = np.bitwise_count(met[at]) / aw
                longest = np.maximum(size[at], la)
                extra = raw[at] - ar
                rest = shared * 0.32 + colon[at] + (0.05 + prior) + issue * marks[at, 0] - numbered * ~marks[at, 1] - to * ~marks[at, 2] - np.where(extra > 2, np.minimum(0.18, extra * 0.05), 0) - np.where(extra < 0, np.minimum(0.26, -extra * 0.12), 0)
                bound = 0.55 * np.minimum(size[at], la) / longest + rest + 0.15
                may = bound >= self.floor - 1e-9
                at, longest, rest = at[may], longest[may], rest[may]
                if not len(at):
                    continue
                letters = self.bags[code[hit[at]]].astype(np.int32)
                for i in range(1, n):
                    letters += self.bags[code[hit[at] + i]]
                letters[:, 36] = np.maximum(size[at] - letters[:, :36].sum(axis=1), 0)
                common = np.minimum(letters, bag).sum(axis=1)
                where = hit[at]
                right, down = cx[where], np.minimum.reduce([cy[where + i] for i in range(n)])
                place = np.where(right < 0.55, 0.05, 0.0)
                if prior and self.aliases[j][0] in ("invoiceNumber", "invoiceDate", "dueDate"):
                    place += np.where(down < 0.35, np.where(right > 0.45, 0.08, 0.05), -0.03)
                elif prior:
                    place += np.where(down > 0.5, np.where(right > 0.4, 0.08, 0.04), -0.03)
                bound = 0.55 * common / longest + (rest - 0.05 - prior) + place + np.where(common == longest, 0.15, 0.08)
                may = bound >= self.floor - 1e-9
                at, bound = at[may], bound[may]
                out.append((hit[at], np.full(len(at), n), np.full(len(at), j), np.minimum(bound + 1e-9, 1.0)))
        return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, dtype=np.int64)] * 4

    def pages(self, batch: pa.RecordBatch) -> pa.Array:
        """The labels found on each page, with the lines of their regions."""
        col = lambda c: batch.column(batch.schema.get_field_index(c))
        texts = col("text")
        counts = pc.fill_null(pc.list_value_length(texts), 0).to_numpy().astype(np.int64)
        ends = np.cumsum(counts)
        page = np.repeat(np.arange(len(counts)), counts)
        seq, x, y, w, h = (col(c).flatten().to_numpy() for c in ("token_seq", "x", "y", "w", "h"))
        page_w, page_h = col("page_w").to_numpy(), col("page_h").to_numpy()
        centre = y + h / 2.0
        order = sorted_by(page, 2 * y + h, x, seq)
        rows = np.empty(len(order), dtype=np.int64)
        rows[order] = rows_of_pages(centre[order], h[order], counts)
        order = sorted_by(page, rows, x, seq)
        rows = rows[order]
        text = texts.flatten().take(pa.array(order))
        x, y, w, h = x[order], y[order], w[order], h[order]
        group = page * (len(order) + 1) + rows
        start, n, alias, bound = self.candidates(self.codes(text), group, x / page_w[page], y / page_h[page])
        first = np.ones(len(group), dtype=bool)
        first[1:] = group[1:] != group[:-1]
        place = np.arange(len(group)) - np.maximum.accumulate(np.where(first, np.arange(len(group)), 0))
        best: dict[tuple[int, str], tuple] = {}
        names = np.array([x[4] for x in self.aliases])
        field_of, name_of = (np.unique(v, return_inverse=True)[1] for v in ([x[0] for x in self.aliases], names))
        which = page[start] * len(self.aliases) + field_of[alias] if len(start) else np.zeros(0, dtype=np.int64)
        ranked = np.lexsort((name_of[alias], n, start, -bound, which)) if len(start) else start
        which = which[ranked]
        head = np.ones(len(ranked), dtype=bool)
        head[1:] = which[1:] != which[:-1]
        settled = np.zeros(len(ranked), dtype=bool)

        def score(k: int) -> float:
            s, m, j, q = int(start[k]), int(n[k]), int(alias[k]), int(page[start[k]])
            field, _, _, _, name = self.aliases[j]
            base = placeless(" ".join(t for t in text[s : s + m].to_pylist() if t is not None), name, field)
            if base is None:
                return 0.0
            got = placed(base, field, x[s] / page_w[q], y[s : s + m].min() / page_h[q])
            key = (-got, s, m, name)
            held = best.get((q, field))
            if got >= self.floor and (held is None or key < held[0]):
                best[q, field] = key, s, m, j
            return got

        heads = np.flatnonzero(head)
        done = np.array([score(k) == 1.0 for k in ranked[heads].tolist()], dtype=bool)  # of those that may be 1 the first is it: no other wins
        settled = np.repeat(done, np.diff(np.append(heads, len(ranked)))) if len(heads) else settled
        rest = ranked[~settled & ~head]
        for k, q, j, up in zip(rest.tolist(), page[start[rest]].tolist(), alias[rest].tolist(), bound[rest].tolist(), strict=True):
            held = best.get((q, self.aliases[j][0]))
            if held is None or up >= -held[0][0]:
                score(k)
        out: list[list] = [[] for _ in counts]
        cx, cy = (x + w / 2) / page_w[page], (y + h / 2) / page_h[page]
        for (q, field), (key, s, m, j) in best.items():
            _, kind, below, critical, _ = self.aliases[j]
            left, top = int(x[s : s + m].min()), int(y[s : s + m].min())
            x0, y0, x1, y1 = region(left, top, int((x[s : s + m] + w[s : s + m]).max()) - left, int((y[s : s + m] + h[s : s + m]).max()) - top, int(page_w[q]), int(page_h[q]), below, kind == "address")
            a, b = ends[q] - counts[q], ends[q]
            at = a + np.flatnonzero((cx[a:b] >= x0) & (cx[a:b] <= x1) & (cy[a:b] >= y0) & (cy[a:b] <= y1))
            if len(at):
                lines: dict[int, list[str]] = {}
                for r, t in zip(rows[at].tolist(), text.take(pa.array(at)).to_pylist(), strict=True):
                    lines.setdefault(r, []).extend([] if t is None else [t])
                out[q].append({"field": field, "kind": kind, "critical": critical, "score": -key[0], "lines": [" ".join(v) for v in lines.values()]})
        kinds = pa.struct([("field", pa.string()), ("kind", pa.string()), ("critical", pa.bool_()), ("score", pa.float64()), ("lines", pa.list_(pa.string()))])
        return pa.array(out, pa.list_(kinds))


def finder(floor: float):
    """For ``mapInArrow``: pages of arrays to (doc_id, page_no, found)."""

    def find(batches):
        f = Finder(floor)
        for batch in batches:
            for a in range(0, batch.num_rows, PAGES):
                part = batch.slice(a, PAGES)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), f.pages(part)], names=["doc_id", "page_no", "found"])

    return find
