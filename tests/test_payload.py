import base64
import random

from gatesift.functions import payload as P
from gatesift.functions.text import has_content


def decoded(spark, payloads):
    df = spark.createDataFrame(list(enumerate(payloads)), "id INT, file STRING")
    rows = P.with_decoded_base64(df, "file", "data").orderBy("id").collect()
    return [None if r.data is None else bytes(r.data) for r in rows]


def python_decode(payload):
    try:
        return base64.b64decode(payload)
    except Exception:
        return None


def test_known_payloads(spark):
    cases = {
        "VGhpcw==": b"This", "VG!hpcw==": b"This", "VGhpcw": None, "é": None,
        "VGhpcw==VGhp": b"This", "VG=hpcw==": b"This", "=VGhp": b"Thi", "VGhpcw=": None,
        "!!!!": b"", "": b"", "VGhpcw=\n": None, "VGhp\r\ncw==\n": b"This",
    }
    assert decoded(spark, list(cases)) == list(cases.values())


def test_fuzzed_payloads_match_python(spark):
    rng = random.Random(7)
    payloads = ["".join(rng.choice("AbZ9+/==\n !é" if rng.random() < .2 else "AbZ9+/=\n-")
                        for _ in range(rng.randrange(14))) for _ in range(4000)]
    payloads += [base64.b64encode(rng.randbytes(n)).decode() for n in range(200)]
    payloads += [base64.encodebytes(rng.randbytes(n)).decode() for n in range(100, 200)]
    assert decoded(spark, payloads) == [python_decode(p) for p in payloads]


def samples():
    rng = random.Random(3)
    out = [b"", b"plain", "héllo wörld".encode(), b"\xff\xfe\x00abc", b"\xe2\x82",
           "genuine � mark".encode(), b"\xef\xbf\xbd\xff\x01a\x01b\xef\xbf\xbd",
           "​​​".encode(), "　  \x1c\x85".encode(),
           ("€" * 400).encode(), b"%PDF-1.4 x", b"%PD", b"\x01" * 90 + b"a" * 10]
    for _ in range(300):
        n = rng.randrange(1, 1500)
        out.append(bytes(rng.choice([rng.randrange(256), rng.randrange(32, 127), 10])
                         for _ in range(n)))
    for share in range(100):
        out.append(b"\x02" * share + b"y" * (600 - share * 5))
    return out


def test_lenient_decoding_and_kind_match_python(spark):
    data = samples()
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)],
                               "id INT, content BINARY")
    rows = P.with_file_kind(df, "content", "kind").select(
        "id", "kind", P.decode_leniently("content").alias("text")).orderBy("id").collect()
    assert [r.text for r in rows] == [d.decode("utf-8", errors="ignore") for d in data]

    def kind(d):
        if d[:4] == b"%PDF":
            return "pdf"
        sample = d[:1024].decode("utf-8", errors="ignore")
        good = sum(c.isprintable() or c.isspace() for c in sample)
        return "text" if sample and good / len(sample) > 0.85 else None

    assert [r.kind for r in rows] == [kind(d) for d in data]


def test_blank_texts(spark):
    values = ["", "   ", " ", "\t\n\x0b\x0c\r", "\x1c\x1d\x1e\x1f", "  　",
              "\x85", "a", " ​", "\x00", ".", None]
    df = spark.createDataFrame(list(enumerate(values)), "id INT, text STRING")
    got = [r[0] for r in df.orderBy("id").select(has_content("text")).collect()]
    assert got == [bool(v and v.strip()) for v in values]
