import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[4]").appName("tests")
               .config("spark.sql.shuffle.partitions", "4")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


VOCAB = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", *"abcdefghijklmnopqrstuvwxyz.,!?-",
         *("##" + c for c in "abcdefghijklmnopqrstuvwxyz"), "the", "cat", "sat", "mat", "##ing", "on"]


@pytest.fixture(scope="session")
def vocabulary():
    return {token: i for i, token in enumerate(VOCAB)}


@pytest.fixture(scope="session")
def tokenizer(spark, vocabulary):
    from tokenmill.operators import encode
    return encode.wordpiece(spark, vocabulary)


@pytest.fixture(scope="session")
def library(vocabulary):
    """The tokenizer library itself, to compare with."""
    from tokenizers import BertWordPieceTokenizer
    return BertWordPieceTokenizer(vocabulary)


@pytest.fixture
def files(spark):
    def make(texts, partitions=2):
        rows = [(key, text, len(text)) for key, text in texts.items()]
        return spark.createDataFrame(rows, "file_key string, text string, n_chars long").repartition(partitions)
    return make
