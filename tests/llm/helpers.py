import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def low_words(text):
    return WORD.findall((text or "").translate(LOW))


def fold(doc_id, n=5):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def documents(spark, texts, ids=None, source=None, extra=False):
    """Rows of documents; with ``extra``, columns whose names operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", source[k] if source else "s", None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        from pyspark.sql import functions as F

        for c in ("row", "key", "cls", "size", "kept", "spans", "words", "part", "h", "n", "word", "taken", "target", "id", "label"):
            df = df.withColumn(c, F.lit("clash"))
    return df


def prose(n, seed, vocabulary=400):
    import random

    rng = random.Random(seed)
    names = ["".join(random.Random(k).choices("abcdefghé", k=2 + k % 7)) for k in range(vocabulary)]
    return " ".join(rng.choice(names) for _ in range(n))
