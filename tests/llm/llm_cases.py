"""Cases and plain helpers for the tests of this folder."""

import os
import re

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns that operators use inside, to clash with theirs.
CLASHING = "key k kind hash size score fp unit uid crc n_words rank shard content part edge of source_size".split()
ODD = [
    None, "", " \n\t ", "one", "a b", "A  B\n", "a b c a b c", "x\n\nx\nx \n y", "don't we'll IT'S <|endoftext|> z <|ENDOFTEXT|>",
    "a@b@c.com x@y.z@q.com", "1.2.3.4.5.6.7.8 256.1.1.1", "+1 (385) 555-1563. +1+22 333 4444", "4111 1111 1111 1111 4111-1111-1111-1112",
    "bob at mail dot com, é 4111.1111.1111.1111 10[.]0[.]3[.]4", "日本語 テスト 　x", "9" * 3000, "w" * 20_000, "tail ", "  lead  two", "é é ß İ", "the " * 9000,
]


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def in_order(found):
    return sorted((tuple(r) for r in found), key=lambda r: tuple((v is None, str(v)) for v in r))
