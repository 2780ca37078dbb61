"""Packing by concatenate and cut.

Pass one tokenises every document inside its scan task and writes its ids with
its offset inside the task. The token totals of the tasks (one row each) are
prefix-summed into global offsets; pass two cuts the stream of all tokens at
multiples of the window: a document that crosses a cut becomes two or more
pieces (boundary records), one row each. Nothing but the task totals is
shuffled. All sequences are full except the last.

Defined results: null text is empty, a document without tokens still has its
end id; a text that fills many windows gives one piece per window; repeated rows
are packed each; rows with null id are packed with a null id; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.llm.common import small_batches, worker_cache, written

WINDOW = 4096
END_ID = 2
WORD_END = "</w>"
STRING_WORDS = 200           # cores encoded in one string
REMEMBERED = 1_000_000       # cores that a Python worker keeps (about 30 MB); forgetting costs time only
CHARS_PER_BATCH = 8_000_000  # larger batches share more words; one longer text is a batch of its own


class WordTokenizer:
    """Texts -> ids, word by distinct word.

    The tokenizer never joins characters across ASCII white space (its split
    pattern has no white space, and neither composition nor lower-casing looks
    across a space), so a text's ids are those of its words in a row, and the
    distinct words of a batch are encoded once. A word that begins with letters
    and goes on with ASCII from another character has the ids of the letters,
    then those of the rest: the pattern's match of the letters ends there, and
    nothing composes with ASCII. A core of letters is one match, and only its
    last token ends a word, so many cores are encoded in one string and told
    apart by those tokens; a string where the count is off is encoded word by
    word. Cores of earlier batches are remembered.
    """

    def __init__(self, path: str):
        import os

        import numpy as np
        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        # the same for lower-case ASCII letters between spaces, without the work on others
        self.light = Tokenizer.from_file(path)
        self.light.normalizer = None
        self.light.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(WORD_END)]] = True
        self.known = pa.array([], pa.string())
        self.known_ids, self.known_n = np.zeros(0, "<u4"), np.zeros(0, "int64")

    def one_by_one(self, words: list):
        """(ids in a row, number of ids per word)."""
        import numpy as np
        got = [e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]
        return (np.array([i for ids in got for i in ids], "<u4"), np.array([len(ids) for ids in got], "int64"))

    def of_letters(self, words: list, tok):
        import numpy as np
        ids, sizes = [np.zeros(0, "<u4")], [np.zeros(0, "int64")]
        for at in range(0, len(words), STRING_WORDS):
            part = words[at:at + STRING_WORDS]
            got = np.array(tok.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            stop = np.flatnonzero(self.ends[got]) + 1
            size = np.diff(np.concatenate([[0], stop]))
            if len(stop) != len(part):
                got, size = self.one_by_one(part)
            ids.append(got)
            sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes)

    def learn(self, cores) -> None:
        """Afterwards ``known`` holds all of ``cores``."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        new = cores.filter(pc.invert(pc.is_in(cores, self.known)))
        if len(self.known) + len(new) > REMEMBERED:
            self.known, self.known_ids, self.known_n = self.known[:0], self.known_ids[:0], self.known_n[:0]
            new = cores
        ascii_ = pc.string_is_ascii(new)
        # Unicode lower-casing may look around, ASCII's does not
        a, b = new.filter(ascii_), new.filter(pc.invert(ascii_))
        ids1, n1 = self.of_letters(a.to_pylist(), self.light)
        ids2, n2 = self.of_letters(b.to_pylist(), self.tok)
        self.known = pa.concat_arrays([self.known, a, b])
        self.known_ids = np.concatenate([self.known_ids, ids1, ids2])
        self.known_n = np.concatenate([self.known_n, n1, n2])

    def of_words(self, words):
        """Distinct words (Arrow strings) -> (ids in a row, number of ids per word)."""
        import numpy as np
        import pyarrow.compute as pc

        cut = pc.extract_regex(words, r"^(?P<core>\pL*)(?P<rest>(?s:.*))$")
        core, rest = cut.field("core"), cut.field("rest")
        split = pc.and_(pc.greater(pc.binary_length(core), 0), pc.string_is_ascii(rest))
        core, rest = core.filter(split), rest.filter(split).dictionary_encode()
        core = pc.if_else(pc.string_is_ascii(core), pc.ascii_lower(core), core).dictionary_encode()
        self.learn(core.dictionary)
        ids1, n1 = self.known_ids, self.known_n
        ids2, n2 = self.one_by_one(rest.dictionary.to_pylist())
        ids3, n3 = self.one_by_one(words.filter(pc.invert(split)).to_pylist())
        # a word has one or two pieces of the three id lists in a row
        ids, n = np.concatenate([ids1, ids2, ids3]), np.concatenate([n1, n2, n3])
        first, second = np.empty(len(words), "int64"), np.full(len(words), -1)
        two = split.to_numpy(zero_copy_only=False)
        place = pc.index_in(core.dictionary, self.known).to_numpy(zero_copy_only=False)
        first[two] = place[core.indices.to_numpy(zero_copy_only=False)] if len(place) else 0
        second[two] = len(n1) + rest.indices.to_numpy(zero_copy_only=False)
        first[~two] = len(n1) + len(n2) + np.arange(len(n3))
        pieces = np.stack([first, second], 1).reshape(-1)
        owner = np.repeat(np.arange(len(words)), 2)[pieces >= 0]
        pieces = pieces[pieces >= 0]
        at = np.cumsum(n) - n
        return ids[_spans(at[pieces], n[pieces])], np.bincount(owner, n[pieces], len(words)).astype("int64")

    def encode(self, texts):
        """Arrow strings (no nulls) -> (ids in a row, number of ids per text)."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        ids, n = self.of_words(coded.dictionary)
        word = coded.indices.to_numpy(zero_copy_only=False)
        size = n[word]
        out = ids[_spans((np.cumsum(n) - n)[word], size)]
        upto = np.concatenate([[0], np.cumsum(size)])
        ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        return out, np.diff(np.concatenate([[0], upto[ends]]) if len(ends) else np.zeros(1, "int64"))


def _spans(start, size):
    """Indices of the spans [start, start + size) in a row."""
    import numpy as np
    total = np.cumsum(size)
    return np.arange(int(total[-1]) if len(total) else 0) + np.repeat(start - (total - size), size)


def tokenised(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, end_id: int) -> DataFrame:
    """part, doc_id, at (tokens before it in its task), n, ids; written."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("doc_id", kind),
                           T.StructField("at", T.LongType()), T.StructField("n", T.LongType()),
                           T.StructField("ids", T.BinaryType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        cache = worker_cache("word tokenizers")
        if tokenizer_path not in cache:
            cache[tokenizer_path] = WordTokenizer(tokenizer_path)
        tokenizer = cache[tokenizer_path]
        end = np.array([end_id], "<u4").tobytes()
        for b in small_batches(batches, "text", CHARS_PER_BATCH):
            ids, n = tokenizer.encode(pc.fill_null(b.column("text"), ""))
            stop = np.cumsum(n)
            raw = ids.astype("<u4").tobytes()
            rows = [raw[4 * (e - k):4 * e] + end for e, k in zip(stop.tolist(), n.tolist())]
            n = n + 1
            first = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, "int32")), b.column("doc_id"), pa.array(first), pa.array(n),
                 pa.array(rows, pa.binary())], names=["part", "doc_id", "at", "n", "ids"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return written(src.mapInArrow(run, schema))


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary), doc_tokens, sequence_id, offset."""
    t = tokenised(docs, id_col, text_col, tokenizer_path, end_id)
    # one row per scan task of pass one
    before = (t.groupBy("part").agg(F.sum("n").alias("total"))
              .select("part", F.coalesce(F.sum("total").over(
                  Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")))
    w = F.lit(window).cast("long")
    placed = t.join(F.broadcast(before), "part").withColumn("g", F.col("before") + F.col("at"))
    cut = placed.withColumn("sequence_id", F.explode(F.sequence(
        F.expr(f"g div {window}"), F.expr(f"(g + n - 1) div {window}"))))
    start = F.greatest(F.col("sequence_id") * w - F.col("g"), F.lit(0).cast("long"))
    stop = F.least((F.col("sequence_id") + 1) * w - F.col("g"), F.col("n"))
    return (cut.withColumn("start", start).withColumn("length", stop - start)
            .select("doc_id", "start", "length",
                    F.expr("substring(ids, cast(start * 4 + 1 as int), cast(length * 4 as int))").alias("ids"),
                    F.col("n").alias("doc_tokens"), "sequence_id",
                    (F.col("g") + F.col("start") - F.col("sequence_id") * w).alias("offset")))


def piece_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")
