"""Fill-in-the-middle arrangements by a piece table.

A document is a list of descriptors (buffer, start, length) over two buffers that never change: its text and
the sentinels. Cutting splits a descriptor, an arrangement permutes them and sets sentinels between, and
nothing but descriptors moves: text is read out of the buffers once, where an output or a hash is
written. Restoring lays a piece table over the output, takes its sentinels out and undoes the permutation.

Only DataFrame functions, row by row: no shuffle, nothing is held but one row. Starts and lengths are code points.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = PREFIX + SUFFIX + MIDDLE
#: per form the sentinels in their order and the pieces behind them (0 prefix, 1 middle, 2 suffix)
FORMS = {
    "psm": ((PREFIX, SUFFIX, MIDDLE), (0, 2, 1)),
    "spm": ((SUFFIX, PREFIX, MIDDLE), (2, 0, 1)),
}
_TEXT, _SENTINEL = 0, 1


def piece(buffer: int, start: Column, length: Column) -> Column:
    return F.struct(F.lit(buffer).alias("buffer"), start.cast("int").alias("start"), length.cast("int").alias("length"))


def whole(text: Column) -> Column:
    """The piece table of an uncut text."""
    return F.array(piece(_TEXT, F.lit(0), F.length(text)))


def cut(pieces: Column, at: Column) -> Column:
    """Split the last descriptor of the text that reaches ``at`` into two, either of which may be empty."""
    reach = F.transform(pieces, lambda p, i: F.when((p["buffer"] == _TEXT) & (p["start"] <= at) & (at <= p["start"] + p["length"]), i).otherwise(-1))
    split = F.array_max(reach)

    def parts(p: Column, i: Column) -> Column:
        two = F.array(piece(_TEXT, p["start"], at - p["start"]), piece(_TEXT, at, p["start"] + p["length"] - at))
        return F.when(i == split, two).otherwise(F.array(p))

    return F.flatten(F.transform(pieces, parts))


def arrange(pieces: Column, form: str) -> Column:
    """The pieces in a form's order, each behind its sentinel."""
    marks, order = FORMS[form]
    return F.array(*[d for mark, k in zip(marks, order) for d in (_mark(mark), pieces[k])])


def _mark(mark: str) -> Column:
    return piece(_SENTINEL, F.lit(SENTINELS.index(mark)), F.lit(len(mark)))


def find(output: Column, form: str) -> Column:
    """The piece table of an output, in its order and with its sentinels, found by looking for them."""
    marks, _ = FORMS[form]
    starts = [F.instr(output, mark) - 1 for mark in marks]
    ends = [*starts[1:], F.length(output)]
    return F.array(*[d for mark, start, end in zip(marks, starts, ends) for d in (_mark(mark), piece(_TEXT, start + len(mark), end - start - len(mark)))])


def undo(pieces: Column, form: str) -> Column:
    """Sentinels out, and the inverse permutation: prefix, middle and suffix."""
    _, order = FORMS[form]
    texts = F.filter(pieces, lambda p: p["buffer"] == _TEXT)
    return F.array(*[texts[order.index(k)] for k in range(len(order))])


def read(pieces: Column, text: Column) -> Column:
    """What the descriptors stand for, one after another."""
    parts = F.transform(pieces, lambda p: F.substring(F.when(p["buffer"] == _TEXT, text).otherwise(F.lit(SENTINELS)), p["start"] + 1, p["length"]))
    return F.array_join(parts, "")


def sha256(pieces: Column, text: Column) -> Column:
    return F.sha2(read(pieces, text), 256)


def draws(key: Column, count: int = 4, seed: str = "1:") -> list[Column]:
    """Numbers from the hash of a key: its first groups of eight hexadecimal digits."""
    said = F.sha2(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(said, 8 * i + 1, 8), 16, 10).cast("long") for i in range(count)]


def cut_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", into: str = "fim", plain_share: int = 10, spm_share: int = 20) -> DataFrame:
    """Adds a struct ``into``: n, form, prefix_chars, middle_chars, and pieces (the arranged descriptors).

    Form and cuts hang on the key alone. ``plain_share`` of a hundred documents stay as they are, of the others ``spm_share`` of a hundred
    begin with the suffix. Empty and null texts, and those that hold a sentinel, are plain: one descriptor, no cuts (null). A null
    key draws as an empty one; rows of one key draw alike, repeated rows stay repeated. An empty table gives an empty one. All
    columns are kept as they are; where one is called as ``into`` says, it is replaced, so name another.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    holds = reduce(lambda a, b: a | b, [F.contains(body, F.lit(m)) for m in FORMS["psm"][0]])
    h1, h2, h3, h4 = draws(F.col(key))
    n = F.length(body)
    drawn = F.struct(whole(body).alias("table"), n.alias("n"), (h1 % (n + 1)).alias("a"), (h2 % (n + 1)).alias("b"), h3.alias("h3"), h4.alias("h4"), holds.alias("holds"))

    def described(d: Column) -> Column:
        form = F.when((d["n"] == 0) | d["holds"] | (d["h3"] % 100 >= 100 - plain_share), "plain").when(d["h4"] % 100 < spm_share, "spm").otherwise("psm")
        first, second = F.least(d["a"], d["b"]), F.greatest(d["a"], d["b"])
        three = cut(cut(d["table"], first), second)
        laid = F.transform(F.array(three), lambda t: reduce(lambda c, name: c.when(form == name, arrange(t, name)), FORMS, F.when(form == "plain", d["table"])))[0]
        return F.struct(
            d["n"].cast("long").alias("n"),
            form.alias("form"),
            F.when(form != "plain", first).alias("prefix_chars"),
            F.when(form != "plain", second - first).alias("middle_chars"),
            laid.alias("pieces"),
        )

    # lambda variables are computed once a row; a column named again would be computed again
    return docs.withColumn(into, F.transform(F.array(drawn), described)[0])


def transformed(docs: DataFrame, *, key: str = "doc_id", text: str = "text", into: str = "fim", **shares: int) -> DataFrame:
    """The documents with their texts arranged, and ``into`` as in ``cut_documents``. Null texts become empty ones."""
    described = cut_documents(docs, key=key, text=text, into=into, **shares)
    return described.withColumn(text, read(F.col(f"`{into}`.pieces"), F.coalesce(F.col(text), F.lit(""))))


def restored(output: Column, form: Column, reader: Callable[[Column, Column], Column] = read) -> Column:
    """The text an output was made from, out of the output and its form alone. ``reader`` may be ``sha256``, for its hash."""
    text = F.when(form == "plain", reader(whole(output), output))
    for name in FORMS:
        text = text.when(form == name, reader(undo(find(output, name), name), output))
    return text


def hashes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **shares: int) -> DataFrame:
    """One row per document: key, the fields of ``cut_documents``, output, output_sha256 and restored_sha256.

    The first hash reads the buffers by the arranged descriptors; the second reads the output by those that were found in it.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = cut_documents(docs.select(F.col(key).alias("key"), body.alias("text")), key="key", **shares)
    pieces = F.col("fim.pieces")
    rows = rows.select("key", "fim", read(pieces, F.col("text")).alias("output"), sha256(pieces, F.col("text")).alias("output_sha256"))
    back = restored(F.col("output"), F.col("fim.form"), sha256).alias("restored_sha256")
    return rows.select(F.col("key").alias(key), "fim.*", "output", "output_sha256", back)
