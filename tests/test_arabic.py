"""Arabic repair over whole tables against plain loops."""

import re
import unicodedata
from collections import defaultdict

from docloom.operators import arabic as A
from docloom.plans import arabic as Q

DIR = "/root/testdata/sf0.001"


def is_arabic(c):
    return any(a <= ord(c) <= b for a, b in ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)))


def n_arabic(t):
    return sum(map(is_arabic, t))


def n_latin(t):
    return sum(c.isascii() and c.isalpha() or 0xC0 <= ord(c) <= 0x24F for c in t)


def plain(t):
    t = unicodedata.normalize("NFKC", t).translate(str.maketrans("آأإٱٳٵىیۍېۑٸة٫٬٠١٢٣٤٥٦٧٨٩", "اااااايييييي" + "ه" + ".,0123456789", "ـ"))
    return re.sub(r"\s+", " ", t).strip()


def kind(c):
    return "a" if is_arabic(c) else "l" if c.isascii() and c.isalpha() else "d" if c in "0123456789" else "o"


def pieces(t):
    out, ar, la = [t[:1]], n_arabic(t), sum(c.isascii() and c.isalpha() for c in t)
    for a, b in zip(t, t[1:], strict=False):
        ka, kb = kind(a), kind(b)
        between = {ka, kb} == {"a", "l"} or ("d" in (ka, kb) and {ka, kb} & {"a", "l"} and len(t) >= 4 and ((ar >= 3 and not la) or la >= 5))
        if between:
            out.append("")
        out[-1] += b
    return out


def repair(words):
    """(list of lines of words, changes) of one line; words: dicts with text, conf and a box."""
    log, text = [], lambda ws: " ".join(w["text"] for w in ws)
    now = [w | {"text": plain(w["text"])} for w in words]
    one, k = [], 0
    while k < len(now):
        run = k
        while run < len(now) and re.fullmatch(r"[ً-ٰٟ]*.[ً-ٰٟ]*", now[run]["text"]) and n_arabic(now[run]["text"]) == 1:
            run += 1
        if run - k >= 2:
            part = now[k:run]
            confs, boxes = [w["conf"] for w in part if w["conf"] is not None], [w for w in part if w["x"] is not None]
            left, right = min((w["x"] for w in boxes), default=None), max((w["x"] + w["width"] for w in boxes), default=None)
            one.append(part[0] | {"text": "".join(w["text"] for w in part), "conf": min(confs, default=None), "x": left, "width": None if left is None else right - left})
            k = run
        else:
            one.append(now[k])
            k += 1
    if text(one) != text(now):
        log.append(("join-isolated-letters", text(now), text(one)))
    once = []
    for w in one:
        least = 3 if w["conf"] is not None and w["conf"] < 0.8 else 4
        t = re.sub("([ء-ي])\\1+", lambda m, least=least: m[1] if len(m[0]) >= least else m[0], w["text"])
        if t != w["text"]:
            log.append(("collapse-duplicated-letters", w["text"], t))
        once.append(w | {"text": t})
    split = [w | {"text": p} for w in once for p in pieces(w["text"])]
    if text(split) != text(once):
        log.append(("insert-boundary-spaces", text(once), text(split)))
    ar, la = sum(n_arabic(w["text"]) for w in split), sum(n_latin(w["text"]) for w in split)
    if len(split) < 2 or not ar or not la:
        return [split], log
    own, other = (n_arabic, n_latin) if ar >= la else (n_latin, n_arabic)
    stray = [not re.search("[0-9]", w["text"]) and own(w["text"]) == 0 for w in split]
    start = next((k for k, s in enumerate(stray) if not s), len(split))
    end = len(split)
    while end > start and stray[end - 1]:
        end -= 1
    fits = lambda ws: 1 <= sum(other(w["text"]) for w in ws) <= min(4, max(ar, la))
    lead, trail = split[:start] if fits(split[:start]) else [], split[end:] if fits(split[end:]) else []
    main = split[len(lead) : len(split) - len(trail)]
    if not main or not (lead or trail):
        return [split], log
    log += [("detach-edge-fragment", text(split), text(main))] * (bool(lead) + bool(trail))
    return [main, *(x for x in (lead, trail) if x)], log


def turned(words):
    if len(words) < 2 or any(w["x"] is None for w in words):
        return words
    ar, la = sum(n_arabic(w["text"]) for w in words), sum(n_latin(w["text"]) for w in words)
    ordered = all(a["x"] <= b["x"] for a, b in zip(words, words[1:], strict=False))
    return words[::-1] if ar and ar >= la and ordered else words


def pages(spark):
    lines, words = Q.scanned(spark, DIR)
    of = defaultdict(list)
    for w in words.orderBy("doc_id", "line_idx", "word_idx").collect():
        of[w.doc_id, w.line_idx].append(w.asDict())
    return {(r.doc_id, r.line_idx): (r, of[r.doc_id, r.line_idx]) for r in lines.collect()}


def test_repair_equals_a_loop_over_each_line(spark):
    want_log, want_lines, want_turned = {}, defaultdict(list), {}
    kinds = set()
    for (doc, line), (r, words) in sorted(pages(spark).items()):
        parts, log = repair(words)
        if log:
            want_log[doc, line] = log
        kinds |= {k for k, *_ in log}
        want_turned[doc, line] = " ".join(w["text"] for w in turned(words))
        for p in parts:
            p = turned(p)
            confs, boxes = [w["conf"] for w in p if w["conf"] is not None], [w for w in p if w["x"] is not None]
            x = min((w["x"] for w in boxes), default=r.x)
            right = max((w["x"] + w["width"] for w in boxes), default=r.x + r.width)
            text = " ".join(w["text"] for w in p)
            want_lines[doc].append((line, text, text != r.text, round(sum(confs) / len(confs) if confs else r.conf, 6), round(x, 6), round(right - x, 6)))
    got = defaultdict(list)
    for r in Q.ar_repair(spark, DIR).orderBy("doc_id", "line_idx", "step", "pos").collect():
        got[r.doc_id, r.line_idx].append((r.kind, r.original, r.repaired))
    assert got == want_log and len(kinds) == 4
    assert {(r.doc_id, r.line_idx): r.text for r in Q.ar_reconstruct(spark, DIR).collect()} == want_turned
    after = defaultdict(list)
    for r in Q.ar_post_process(spark, DIR).orderBy("doc_id", "line_idx").collect():
        assert r.line_idx == len(after[r.doc_id]) and r.noise_score is not None
        after[r.doc_id].append((r.source_line, r.text, r.repaired, r.conf, r.x, r.width))
    assert after == want_lines


def test_an_empty_page_and_marked_letters(spark):
    kinds = "doc_id long, line_idx int, word_idx int, text string, conf double, x double, y double, width double, height double"
    assert A.repaired(spark.createDataFrame([], kinds))[0].count() == 0
    words = [(1, 0, k, t, None, None, None, None, None) for k, t in enumerate(["سَ", "ل", "ا", "م"])]
    out, log = A.repaired(spark.createDataFrame(words, kinds))
    assert [r.text for r in out.collect()] == ["سَلام"] and [r.kind for r in log.collect()] == ["join-isolated-letters"]
