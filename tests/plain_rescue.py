"""The rescue pass as plain loops over one page, to test the joins and windows against."""

import re

from docloom.sources import dimensions as D

WORDS = D.labels_by_length()


def label_of(text):
    norm = re.sub(r"\s+", " ", text).strip().lower()
    return next((g for w, g in WORDS if w in norm), None)


def n_digits(t):
    return sum(c in "0123456789" for c in t)


def token(text):
    best, most = None, 1
    for t in re.split(r"\s+", text):
        if n_digits(t) > most:
            best, most = t, n_digits(t)
    return best


def numeric(t):
    others = sum(c not in "0123456789.,:/-" for c in t)
    return n_digits(t) >= 4 and n_digits(t) / len(t) >= 0.6 and others <= 2


def label_kind(group, text, phone):
    if group == "number":
        low = text.lower()
        return "reference" if re.search("المرجع|مرجعي|مرجقي|ref", low) else "transaction" if re.search("المعامله|عمليه|عملية|transaction", low) else "number"
    return {"date": "date", "total": "amount", "pos": "account", "buyer": "customer"}.get(group) or ("number" if phone and group == "phone" else None)


AMOUNT = r"\d{1,9}([.,]\d{1,2})?|\d{1,3}([.,]\d{3})+([.,]\d{1,2})?"


def value_kind(v):
    return "date" if re.fullmatch(r"\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}", v) else "amount" if re.fullmatch(AMOUNT, v) else "number"


def valid(kind, text):
    s = re.sub(r"\s+", "", text)
    if kind == "amount":
        return bool(re.fullmatch(AMOUNT, s))
    if kind == "date":
        m = re.search(r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{2,4})", s)
        return bool(m) and 1 <= int(m[1]) <= 31 and 1 <= int(m[2]) <= 12
    return s.isdigit() and 6 <= len(s) <= 20


def mid(b):
    return b["y"] + b["height"] / 2


def rows_shared(a, b):
    return max(0.0, min(a["y"] + a["height"], b["y"] + b["height"]) - max(a["y"], b["y"])) / (min(a["height"], b["height"]) or 1)


def candidates(lines):
    out = []
    for line in lines:
        words = line["words"]
        at = [k for k, w in enumerate(words) if numeric(w["text"])]
        kind = label_kind(label_of(line["text"]), line["text"], False)
        if kind and at:
            right = max(words[k]["x"] + words[k]["width"] for k in at)
            x = min(words[k]["x"] for k in at)
            out.append({"kind": kind, "line": line, "members": at, "text": " ".join(words[k]["text"] for k in at), "x": x, "y": line["y"], "width": right - x, "height": line["height"]})
        elif not kind:
            for k in at:
                t = words[k]["text"]
                beside = k == len(words) - 1 or (k and words[k - 1]["text"] == ":") or words[k + 1]["text"] == ":" or len(words) <= 2
                if n_digits(t) >= 8 and n_digits(t) / len(t) >= 0.85 and sum(c not in "0123456789.,:/-" for c in t) <= 3 and beside:
                    out.append({"kind": "number", "line": line, "members": [k], "text": t} | {c: words[k][c] for c in ("x", "y", "width", "height")})
    return out[:6]


def asked(lines, found):
    """Triggers in their order, and (severe, missing)."""
    out = []
    severe = len(lines) <= 5 or sum(numeric(w["text"]) for line in lines for w in line["words"]) < 3
    if severe:
        out.append({"kind": "full_page", "key": (0, 0)})
    for line in lines:
        t = token(line["text"])
        if line["conf"] < 0.93 and t and n_digits(t) >= 8:
            bare = re.sub("^[^0-9]+|[^0-9]+$", "", t)
            if valid(value_kind(bare), bare):
                out.append({"kind": "digit_line", "key": (1, line["line_idx"]), "line": line, "label": line["text"], "box": line})
    for k, c in enumerate(found):
        if not valid(c["kind"], c["text"]):
            out.append({"kind": "candidate", "key": (2, k + 1), "cand": c, "line": c["line"], "label": c["text"], "box": c})
    for line in lines:
        if label_of(line["text"]) and not any(numeric(w["text"]) for w in line["words"]):
            out.append({"kind": "label", "key": (3, line["line_idx"]), "label": line["text"], "box": line})
    text = "\n".join(line["text"] for line in lines).lower()
    missing = 0 if any(c["kind"] == "amount" for c in found) else sum(bool(re.search(p, text)) for p in ("total|جملة", "cash|نقداً|نقدي", "change|باقي"))
    out += [{"kind": "missing_field", "key": (4, k + 1)} for k in range(missing)]
    return out, severe, missing


def plan(triggers):
    """[(trigger, region or None, covered_by or None)]"""
    picked, out = [], []
    for t in triggers:
        over = None
        if t["kind"] in ("candidate", "label"):
            over = next((k + 1 for k, p in enumerate(picked) if "box" in p and rows_shared(p["box"], t["box"]) >= 0.5), None)
        if over is None and len(picked) < 6:
            picked.append(t)
            out.append((t, len(picked), None))
        else:
            out.append((t, None, over))
    return out, picked


def buckets(items):
    """Items in reading order with bucket: the place by centre of the first of their visual line."""
    held, out = [], []
    for place, t in enumerate(sorted(items, key=lambda t: (mid(t), t["x"], t["item"])), 1):
        if held and mid(t) - mid(held[-1][0]) <= 16:
            held[-1].append(t)
        else:
            held.append([t])
            t["bucket"] = place
        t["bucket"] = held[-1][0]["bucket"]
    for group in held:
        out += sorted(group, key=lambda t: t["x"])
    return out


def pairs(ordered):
    """(candidates, refused) of boxes in reading order."""
    good, bad, open_ = [], [], None
    for t in ordered:
        group, value = label_of(t["text"]), token(t["text"])
        if value is None:
            open_ = t
            continue
        kind = label_kind(group, t["text"], True) or value_kind(value)
        if group:
            good.append(t | {"value": value, "kind": kind})
            open_ = None
        elif open_ is None:
            bad.append((t["text"], "value_without_label"))
        else:
            gap = t["y"] - open_["y"] - open_["height"]
            text = f"{open_['text']} {t['text']}"
            if (abs(mid(t) - mid(open_)) > 16 and gap < 0) or gap > 48:
                bad.append((text, "pair_not_adjacent"))
            else:
                good.append(t | {"text": text, "value": value, "kind": kind, "confidence": min(t["confidence"], open_["confidence"])})
                open_ = None
    return good, bad


def only_digits(s):
    return re.sub("[^0-9]", "", s)


def clashes(found, kind, value, box):
    return any(c["kind"] == kind and valid(kind, c["text"]) and only_digits(c["text"]) != only_digits(value) and rows_shared(c, box) >= 0.8 for c in found)


def put_in(lines, new):
    at = next((k for k, line in enumerate(lines) if mid(line) > mid(new)), len(lines))
    lines.insert(at, new)


def run(lines, readings, budget, recall):
    """(log, record, lines) of a page; readings: {region: [items]}."""
    found = candidates(lines)
    triggers, severe, _ = asked(lines, found)
    digit_lines = any(t["kind"] == "digit_line" for t in triggers)
    record = {"skipped": None, "regions": 0, "attempts": 0, "accepted": 0}
    log, lines = [], [dict(line, was=line["line_idx"]) for line in lines]
    if budget < 4000:
        record["skipped"] = "budget_too_small"
    elif not recall and not digit_lines:
        record["skipped"] = "recall_not_detected"
    elif not any(t["kind"] != "missing_field" for t in triggers):
        record["skipped"] = "no_numeric_problem"
    if record["skipped"]:
        return log, record, lines
    _, regions = plan(triggers)
    record["regions"] = len(regions)
    for k, r in enumerate(regions, 1):
        if budget < 5200:
            break
        items = readings.get(k, [])
        budget -= items[0]["latency"] if items else 0
        record["attempts"] += 1
        told = region(r, [dict(t) for t in items], found, lines)
        record["accepted"] += sum(v == "accepted" for *_, v in told)
        log += [(k, r["kind"], value, verdict) for value, verdict in told]
    if not record["attempts"]:
        record["skipped"] = "budget_exhausted"
    return log, record, lines


def region(r, items, found, lines):
    if r["kind"] in ("candidate", "digit_line"):
        line = next(x for x in lines if x.get("was") == r["line"]["line_idx"])
        pick = None
        for t in sorted(items, key=lambda t: t["item"]):
            if pick is None or n_digits(t["text"]) > n_digits(pick["text"]):
                pick = t
        if r["kind"] == "candidate":
            c = r["cand"]
            if pick is None:
                return [(c["text"], "no_numeric")]
            if pick["confidence"] < 0.85:
                return [(pick["text"], "low_conf")]
            if not valid(c["kind"], pick["text"]):
                return [(pick["text"], "invalid")]
            if clashes(found, c["kind"], pick["text"], c):
                return [(pick["text"], "conflict_with_valid_primary")]
            words = line["text"].split()
            confs = [line["conf"]] * (len(words) - len(c["members"])) + [pick["confidence"]]
            line["text"] = " ".join(pick["text"] if k == c["members"][0] else w for k, w in enumerate(words) if k == c["members"][0] or k not in c["members"])
            line["conf"] = sum(confs) / len(confs)
            return [(pick["text"], "accepted")]
        original = token(line["text"])
        if pick is None:
            return [(original, "no_numeric")]
        if pick["confidence"] < 0.6:
            return [(pick["text"], "low_conf")]
        runs = [x for x in re.findall("[0-9]+", pick["text"]) if len(x) >= 2]
        fresh = max(runs, key=len) if runs else token(pick["text"]) or pick["text"]
        if n_digits(fresh) < n_digits(original):
            return [(pick["text"], "shorter")]
        if only_digits(fresh) == only_digits(original):
            return [(pick["text"], "unchanged")]
        kind = label_kind(label_of(r["label"]), r["label"], True) or value_kind(original)
        if not valid(kind, fresh):
            return [(pick["text"], "invalid")]
        line["text"], line["conf"] = line["text"].replace(original, fresh, 1), pick["confidence"]
        return [(pick["text"], "accepted")]
    good, bad = pairs(buckets([t for t in items if t["x"] is not None and t["confidence"] > 0]))
    told, n = list(bad), 0
    for c in good:
        if n >= 8:
            break
        present = "".join(only_digits(x["text"]) for x in lines)
        if r["kind"] == "missing_field" and c["kind"] != "amount":
            verdict = "kind_mismatch"
        elif c["confidence"] < 0.85:
            verdict = "low_conf"
        elif not valid(c["kind"], c["value"]):
            verdict = "invalid"
        elif only_digits(c["value"]) in present:
            verdict = "value_already_present"
        elif clashes(found, c["kind"], c["value"], c):
            verdict = "conflict_with_valid_primary"
        else:
            verdict = "accepted"
            put_in(lines, {"text": c["text"], "conf": c["confidence"], "y": c["y"], "height": c["height"], "was": None})
            n += 1
        told.append((c["value"], verdict))
    return told
