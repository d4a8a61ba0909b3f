"""Random keys of digits and letters of one case, beside plain identifiers."""

import string

import numpy as np

from matchloom.llm import secrets

PLAIN = (
    "internationalization2024", "user_profile_20240115_backup_table", "release20240115candidate12", "my-long-service-name-v2-deployment",
    "/usr/share/fonts/truetype/dejavu2", "ERRORCODE20240115UNKNOWN", "CONFIG_MAX_RETRIES_PER_CONNECTION_10", "xyz123xyz123xyz123xyz123",
    "postgresql15serverpackage", "ISO88591CHARACTERENCODING",
)


def test_keys_of_one_case(spark):
    rng = np.random.default_rng(3)
    for kind, symbols in (("entropy_lower", string.ascii_lowercase + string.digits), ("entropy_upper", string.ascii_uppercase + "234567")):
        for size in (32, 50):
            keys = ["".join(rng.choice(list(symbols), size)) for _ in range(200)]
            docs = spark.createDataFrame([(i, f"see {k} there") for i, k in enumerate(keys)], "doc_id long, text string")
            found = [{s.kind for s in r.secret_spans} for r in secrets.find_secrets(docs).collect()]
            assert sum(kind in f for f in found) >= (180 if size == 32 else 196), (kind, size, sum(kind in f for f in found))
    docs = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(PLAIN)], "doc_id long, text string")
    assert {r.text for r in secrets.find_secrets(docs).collect() if r.secret_spans} == set()
