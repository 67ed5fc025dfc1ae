"""p6_found: the work a line takes, and that its short cuts find what the patterns find."""

import random
import sys
import unicodedata

from hypothesis import example, given, settings
from hypothesis import strategies as st

from pageloom.llm import normalize, quality, scans

TEXTS = st.text(st.sampled_from("aAbeEiIlLmMnrRcvwxyzZ019 '’-‐¬\xad\t\r\f\n |;,.#*[•éßİΣσаеоПв²½Ⅷ٣“…–_ɡ\xa0\xad​́漢😀"), max_size=60)


def calls(f):
    n = 0

    def tick(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(tick)
    try:
        f()
    finally:
        sys.setprofile(None)
    return n


def test_a_page_is_read_at_once():
    r = random.Random(1)
    lines = ["".join(r.choices("abdfghjkoprstxyz", k=8)) + " put the postcard in the museum " + "".join(r.choices("abdfghjkoprstxyz", k=8)) for _ in range(200)]
    lines[0] = lines[100] = "Storage Handbook for the museum and its librarians"
    assert scans.Reader().edges(lines)[0] == {0, 100}
    assert calls(lambda: scans.Reader().edges(lines)) < 10 * len(lines)  # 27 a line when each was folded by itself


@settings(max_examples=300, deadline=None)
@given(TEXTS)
@example("\r\n ")
def test_short_cuts_find_what_patterns_find(t):
    assert scans.runs(t) == scans._RUN.findall(t)
    assert sorted(quality.words_of(t)) == sorted(quality._WORD.findall(t))
    assert scans.may_break(t) == (scans._BROKEN.search(t) is not None)
    base = normalize._tables()[0]
    assert normalize._mapped(t) == t.translate(base)
    form = normalize.readable_form(t)
    if not t.isascii():
        plain = unicodedata.normalize("NFKC", t.translate(base)).translate(base)
        assert form == (plain if plain.isascii() else unicodedata.normalize("NFC", normalize.one_script(plain)))
    count, other = scans.counted_words(form)
    assert {w.lower() for w in count} == {w.lower() for w in scans._RUN.findall(form) + scans._COMPOUND.findall(form)}
    lines = t.split("\n")
    assert [x[:4] for x in scans._shapes(lines)] == [scans._shapes([x])[0][:4] for x in lines]
