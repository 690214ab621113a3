"""Titles that are notices or meetings and no events: every token gets a class, and rules are patterns over the classes in their order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.quality import first_reason
from .tokens import bound, lookup, tokens

# Limits and words.
LONGEST, REASON_WORDS_MOST, OWNER_WORDS_MOST = 200, 8, 4
BUILDINGS = "office offices building buildings library libraries college campus".split()
HALLS = "city hall, township hall, village hall".split(", ")
SENTENCE_WORDS = "the this that these a an when why how what who after before until since while if is was are were has have had will would not never no day year night time our my your".split()
REASON_WORDS = (
    "for in on of the and at due to observance observed honor today early all noon holiday holidays day days eve break weekend recess staff training service inservice development professional "
    "weather snow inclement emergency maintenance construction renovation renovations repair repairs cleaning inventory new year years martin luther king jr dr mlk presidents president good friday easter memorial juneteenth "
    "independence july fourth labor columbus indigenous peoples election veterans veteran thanksgiving christmas winter spring summer fall monday tuesday wednesday thursday saturday sunday "
    "january february march april may june august september october november december"
).split()
TAG_STOP = "the our my and for a an this your one no any".split()
PRIVATE_TAIL = "in on this at until from today tonight all".split()
BODIES = "council commission commissions commissioners committee committees authority board trustees zoning planning appeals ethics pension dda bia hoa homeowners association".split()
QUALIFIERS = "regular special joint annual emergency work study budget public organizational rescheduled".split()
HEARING_KINDS = "public budget zoning planning tax millage special".split()
STATUSES = "cancelled canceled rescheduled postponed agenda minutes notice budget virtual zoom livestream special regular".split()
EVENT_WORDS = (
    "concert festival fest tour party show live music ticket tickets performance market fair parade trunk treat game games night dinner gala fundraiser fundraisers fundraising workshop class camp tasting brunch lunch "
    "potluck raffle celebration ceremony reception exhibit exhibits exhibition exhibitions cruise"
).split()
INVITING = "meet join visit about with vote attend support tour learn".split()
FACILITIES = "library recreation parks school zoning planning housing water police fire airport transit hospital historic historical".split()
SEATS = "trustees education review appeals commissioners ethics".split()

_TOKEN = r"\d{1,2}(?::\d{2})?\s*[ap]\.?m\b\.?|\d+(?:st|nd|rd|th)?|\p{L}[\p{L}\p{N}'’]*(?:-[\p{L}\p{N}]+)*|[-–—:()]|[^\s\p{L}\p{N}]"
_CLOCK_TOKEN, _NUMBER_TOKEN, _DASH_TOKEN = r"^\d{1,2}(?::\d{2})?\s*[ap]", r"^\d", r"^[-–—:]$"


def classes(title: Column, words: dict[str, str], joined: Iterable[str] = ()) -> Column:
    """A character for each token: that of its word, n a clock time, # a number, - a dash or colon, brackets, a comma for other signs, else x."""
    text = F.coalesce(title, F.lit(""))
    for phrase in joined:  # phrases that are one word
        text = F.regexp_replace(text, rf"(?i)\b{phrase.replace(' ', chr(92) + 's+')}\b", phrase.replace(" ", ""))
    plain = lambda t: F.regexp_replace(t, r"['’]s?$|['’]", "")
    one = lambda t: (
        F.when(t.rlike(_CLOCK_TOKEN), "n").when(t.rlike(_NUMBER_TOKEN), "#").when(t.rlike(_DASH_TOKEN), "-").when(t.isin("(", ")"), t).when(~t.rlike(r"^\p{L}"), ",").otherwise(F.coalesce(F.try_element_at(lookup(words), plain(t)), F.lit("x")))
    )
    return F.array_join(F.transform(tokens(text, _TOKEN), one), "")


def _notice_words() -> dict[str, str]:
    """C closed, U a building, P E Y W L V the words of private events and suites, f for, a an article; else by what a word may be:
    a reason (r), the word of a sentence (t), both (b), a reason and the start of a private event's time (o), that start alone (s), with a sentence (h)."""
    kinds = {(True, False, False): "r", (False, True, False): "t", (True, True, False): "b", (True, False, True): "o", (False, False, True): "s", (False, True, True): "h"}
    out = {w: kinds[(w in REASON_WORDS, w in SENTENCE_WORDS, w in PRIVATE_TAIL)] for w in {*REASON_WORDS, *SENTENCE_WORDS, *PRIVATE_TAIL}}
    out |= {w: "U" for w in (*BUILDINGS, *(h.replace(" ", "") for h in HALLS))}
    return out | {"closed": "C", "private": "P", "event": "E", "events": "E", "party": "Y", "suite": "W", "rental": "L", "rentals": "L", "vip": "V", "for": "f", "a": "a", "an": "a"}


def _meeting_words() -> dict[str, str]:
    """M H S a meeting, hearing, session; B a board, C a commission or committee, L a council, other bodies by their places in names: z zoning and planning, A seats that are bodies,
    V seats that aren't, d one authority's initials, y other bodies; Q qualifiers, by whether they are statuses or kinds of hearings too (g, p, u); k m statuses, t taxes, F facilities, c kinds of places, e events, i invitations."""
    out = {w: "e" for w in EVENT_WORDS} | {w: "i" for w in INVITING if w not in EVENT_WORDS} | {w: "F" for w in FACILITIES} | {w: "V" for w in SEATS} | {w: "y" for w in BODIES}
    for w in QUALIFIERS:
        status, kind = w in STATUSES, w in HEARING_KINDS
        out[w] = "u" if status and kind else "g" if status else "p" if kind else "Q"
    out |= {w: "m" if w in ("agenda", "minutes", "notice") else "k" for w in STATUSES if w not in QUALIFIERS}
    out |= {w: "M" for w in ("meeting", "meetings")} | {w: "H" for w in ("hearing", "hearings")} | {w: "S" for w in ("session", "sessions")}
    out |= {"board": "B", "council": "L", "dda": "d", "pension": "A", "zoning": "z", "planning": "z", "tax": "t", "millage": "t", "truthintaxation": "t", "of": "o", "the": "T", "whole": "W", "officer": "O", "at": "@", "general": "G", "membership": "G"}
    out |= {w: "A" for w in SEATS if w in BODIES and w != "commissioners"} | {w: "C" for w in ("commission", "commissions", "commissioners", "committee", "committees")} | {w: "c" for w in ("city", "town", "village", "township")}
    return out | {w: "9" for w in ("on", "for", "regarding")} | {"openhouse": "e"}


_NOTICE, _MEETING = _notice_words(), _meeting_words()
_SIGN = "[-,()]"
_REASON = f"(?:{_SIGN}*[rbofn#])"
_CLOSURE = f"(?:[^-tbha(),],?){{0,{OWNER_WORDS_MOST}}}UC{_REASON}{{0,{REASON_WORDS_MOST}}}{_SIGN}*$"
#: Rules over the classes of notices, by name.
NOTICES = (
    ("closed_for_private_event", f"^{_SIGN}*Cfa?PE(?:[osh][^-,()]*)?{_SIGN}*$"),
    ("suite_rental", "-V?WL$"),
    ("private_event_label", f"^{_SIGN}*P(?:,?C?E|Y){_SIGN}*$"),
    ("closure_notice", f"^{_CLOSURE}|^{_REASON}{{1,{REASON_WORDS_MOST}}},*[-(]{_SIGN}*{_CLOSURE}"),
)
_BODY, _HELD, _NAME = "[BCLzAdy]", "[MHS]m?$", "[^-(),]"
_ALONE = f"(?:{_NAME}{{1,5}}C|CoTW|HO|BoV|[Fz]B|d{_NAME}?B|{_NAME}{{0,3}}(?:zB(?:oA)?|Bo(?:z?A|V|C)|z[CB]|[AV][BC]|cL|cB))$"
_CALLED = "[QgpuH]*[MHS]"
#: Rules over the classes of meetings, once a leading status and what stands behind the name are gone.
MEETINGS = ("^[pztu]+H(?:$|-|9)", f"^{_NAME}{{0,5}}GM$", f"^{_CALLED}oT?.*{_BODY}", f"^{_CALLED}-(?:{_ALONE}|(?=.*{_BODY}).*{_HELD})", f"^{_ALONE}", f"^(?=.*{_BODY}).*{_HELD}")

#: Words of which a title must hold one, alone or in another word: no rule holds without a C, L or P of notices or a B, C, H, L, M or S of meetings.
NEEDED = tuple(sorted({w for w, k in _NOTICE.items() if k in "CLP"} | {w for w, k in _MEETING.items() if k in "BCHLMS"}))


def _governance(title: Column) -> Column:
    seen = classes(title, _MEETING, ("truth in taxation", "open house"))
    name = F.regexp_replace(F.regexp_replace(seen, "^[kg]-", ""), r"(?:\([^)]*\)|-?@?n|-[kmgu]|,|-)+$", "")
    says = lambda n: ~F.contains(n, F.lit("e")) & ~n.rlike("^i") & n.rlike("|".join(f"(?:{r})" for r in MEETINGS))
    return bound(name, says)


def _tagged(title: Column) -> Column:
    """The title behind a short tag in capitals, or the title."""
    tag = F.regexp_extract(title, r"^\W*([A-Z0-9]{2,6})\s*:?\s", 1)
    return F.when((tag != "") & ~F.lower(tag).isin(*TAG_STOP), F.regexp_replace(title, r"^\W*[A-Z0-9]{2,6}\s*:?\s+", "")).otherwise(title)


def non_event(title: Column) -> Column:
    """The rule by which a title is no event, or null; longer titles than any notice are not read."""
    t = F.coalesce(title, F.lit(""))
    private = dict(NOTICES)["private_event_label"]
    read = F.struct(classes(t, _NOTICE, HALLS).alias("notice"), classes(_tagged(t), _NOTICE).alias("tagged"), t.alias("title"))

    def rule(x: Column) -> Column:
        rules = [(name, x["notice"].rlike(pattern) | (x["tagged"].rlike(private) if name == "private_event_label" else F.lit(False))) for name, pattern in NOTICES]
        return F.nullif(first_reason([*rules, ("governance_meeting", _governance(x["title"]))], ""), F.lit(""))

    may = F.regexp_replace(F.lower(t), "['’]", "").rlike("|".join(NEEDED))
    return F.when((F.trim(t) != "") & (F.length(t) <= LONGEST) & may, bound(read, rule))
