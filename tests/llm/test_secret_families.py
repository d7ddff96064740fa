"""Random keys of every encoding are found; long words, names, paths and numbers are not."""

import random
import string
import uuid

from loomdag.llm import secrets

LOWER, UPPER, DIGIT = string.ascii_lowercase, string.ascii_uppercase, string.digits
FAMILIES = {
    "base36 24": (LOWER + DIGIT, 24), "base36 40": (LOWER + DIGIT, 40), "lower 32": (LOWER, 32), "decimal 24": (DIGIT, 24), "decimal 40": (DIGIT, 40),
    "upper and digit 32": (UPPER + DIGIT, 32), "base32 32": (UPPER + "234567", 32), "base62 32": (LOWER + UPPER + DIGIT, 32), "base64 40": (LOWER + UPPER + DIGIT + "+/", 40),
}
WRITTEN = """internationalizationOfThings src/main/java/org/example/loader/FileReader donaudampfschifffahrtsgesellschaft
get_user_account_by_identifier 00000000000000000000000 2024-01-15_annual-report_final counterrevolutionaries-and-friends
rechtsschutzversicherungsgesellschaften MAXIMUM_NUMBER_OF_CONNECTIONS anticonstitutionnellement/electroencefalografista
12345678901234567890123 home/user/documents/letters/2023/december see-also-the-following-chapter https//www/example/org/index""".split()


def test_families(spark):
    rng = random.Random(12)
    keys = {f: ["".join(rng.choice(a) for _ in range(n)) for _ in range(60)] for f, (a, n) in FAMILIES.items()}
    keys["uuid"] = [str(uuid.UUID(int=rng.getrandbits(128))) for _ in range(60)]
    rows = [(f, f"see {k} there") for f, own in keys.items() for k in own] + [("written", f"see {w} there") for w in WRITTEN * 20]
    got = secrets.secret_spans(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    share = {}
    for r in got:
        share.setdefault(r["doc_id"], []).append(bool(r["spans"]))
    assert not any(share.pop("written"))
    assert {f: sum(x) / len(x) for f, x in share.items() if sum(x) < 0.9 * len(x)} == {}
