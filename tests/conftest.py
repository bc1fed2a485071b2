import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYTHONPATH", sys.path[0])


#: Files whose tests take a minute together: ``pytest -m quick``.
QUICK = {"test_import.py", "test_preparation.py", "test_quality_and_balance.py", "test_context.py", "test_text_and_sources.py", "test_generation.py"}


def pytest_configure(config):
    config.addinivalue_line("markers", "quick: tests that take a minute together")


def pytest_collection_modifyitems(items):
    for item in items:
        if item.path.name in QUICK:
            item.add_marker(pytest.mark.quick)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    own = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    own.sparkContext.setLogLevel("ERROR")
    return own
