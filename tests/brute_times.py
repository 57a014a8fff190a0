"""An independent, row-at-a-time reading of time texts with the standard library, for tests only."""

import datetime as dt
import re
from decimal import Decimal
from zoneinfo import ZoneInfo

UTC = dt.timezone.utc
MON = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}


def brute_instant(text, zone, order):
    if text is None:
        return None
    s = text.strip().lower()
    if re.fullmatch(r"\+?\d+(\.\d*)?(e\+?\d+)?", s) and not re.fullmatch(r"20\d{12}", s):
        for ns in (10**9, 10**6, 10**3, 1):
            v = Decimal(s) * ns
            if 1609459200 * 10**9 <= v < 1767225600 * 10**9:
                return int(v)
        return None
    m = re.search(r"(?:[ t]|^)(\d{1,2}):(\d\d)(?::(\d\d)(?:[.,](\d+))?)?\s*([ap]m)?\s*(.*)$", s)
    if m:
        date, rest = s[: m.start()].strip(" ,"), m.group(6)
        h, mi, sec, frac, half = int(m.group(1)), int(m.group(2)), int(m.group(3) or 0), (m.group(4) or "").ljust(9, "0"), m.group(5)
    else:
        m = re.fullmatch(r"(\d{8})[ t]?(\d\d)(\d\d)(\d\d)\s*(.*)", s)
        if not m:
            return None
        date, rest = f"{m.group(1)[:4]}-{m.group(1)[4:6]}-{m.group(1)[6:]}", m.group(5)
        h, mi, sec, frac, half = int(m.group(2)), int(m.group(3)), int(m.group(4)), "0" * 9, None
    date = re.sub(r"^(mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", "", date)
    parts = re.split(r"[-/., ]+", date)
    if len(parts) != 3:
        return None
    if parts[0][:3] in MON:
        mo, d, y = MON[parts[0][:3]], int(parts[1]), int(parts[2])
    elif parts[1][:3] in MON:
        d, mo, y = int(parts[0]), MON[parts[1][:3]], int(parts[2])
    elif len(parts[0]) == 4:
        y, mo, d = map(int, parts)
    elif order == "dmy":
        d, mo, y = map(int, parts)
    elif order == "mdy":
        mo, d, y = map(int, parts)
    else:
        return None
    if half:
        h = h % 12 + (12 if half == "pm" else 0)
    try:
        wall = dt.datetime(y, mo, d, h, mi, sec)
    except ValueError:
        return None
    rest = re.sub(r"\[.*\]", "", rest).strip()
    o = re.fullmatch(r"([+-])(\d\d):?(\d\d)?", rest)
    if rest in ("z", "utc", "gmt"):
        at = wall.replace(tzinfo=UTC)
    elif o:
        off = dt.timedelta(hours=int(o.group(2)), minutes=int(o.group(3) or 0))
        at = (wall - (off if o.group(1) == "+" else -off)).replace(tzinfo=UTC)
    elif zone is None:
        return None
    else:
        at = wall.replace(tzinfo=ZoneInfo(zone)).astimezone(UTC)
        if at.astimezone(ZoneInfo(zone)).replace(tzinfo=None) != wall:
            return None
        second = wall.replace(tzinfo=ZoneInfo(zone), fold=1)
        if rest and second.tzname().lower() == rest and second.utcoffset() != wall.replace(tzinfo=ZoneInfo(zone)).utcoffset():
            at = second.astimezone(UTC)
    return int((at - dt.datetime(1970, 1, 1, tzinfo=UTC)).total_seconds()) * 10**9 + int(frac[:9])
