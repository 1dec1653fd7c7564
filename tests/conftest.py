import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from millrace.session import Settings, build_session

    extra = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.default.parallelism": "4"}
    session = build_session(Settings(app="tests", master="local[4]", extra=extra))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def engine(spark):
    from millrace.engine import Engine

    own = Engine(spark)
    people = [
        (1, "Alice", 30, 50000.0, True, 85.5),
        (2, "Bob", 25, 45000.0, False, 72.3),
        (3, "Charlie", 30, 60000.0, True, 91.2),
        (4, "Diana", 25, 52000.0, True, 78.9),
        (5, "Eve", 35, 48000.0, False, 88.1),
        (6, "Frank", 30, 55000.0, True, 82.0),
    ]
    own.register_table("people", spark.createDataFrame(people, "id long, name string, age long, salary double, active boolean, score double"))
    gaps = [
        (1, "Alice", 30, 50000.0, True, ["engineer", "senior"], 85.5),
        (2, "Bob", None, 45000.0, False, ["engineer"], None),
        (3, "Charlie", 35, None, True, ["manager"], 91.2),
        (4, "Diana", 28, 52000.0, None, [], 78.9),
    ]
    own.register_table("gaps", spark.createDataFrame(gaps, "id long, name string, age long, salary double, active boolean, tags array<string>, score double"))
    own.register_table("orders", spark.createDataFrame([(10, 1, 5.0), (11, 1, 7.5), (12, 3, 2.0), (13, 9, 1.0), (14, None, 3.0)], "order_id long, user_id long, total double"))
    return own
