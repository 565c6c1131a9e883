import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


TESTDATA = "/root/testdata/sf0.001"
SESSION = (
    "record_id long, source_id string, line_no long, batch_no int, received_at timestamp, record_type string, subtype string, session_id string, uuid string, parent_uuid string, written_at string, project string, cwd string, "
    "is_sidechain boolean, is_meta boolean, is_compact_summary boolean, msg_role string, item_type string, item_text string, item_content string, tool_use_id string, attachment_prompt string"
)
SOURCES = "source_id string, app string, log_path string, zone_name string, fallback_session string, size_bytes long, modified_at timestamp"


@pytest.fixture(scope="session")
def session_rows(spark):
    """Build claude_session rows from dicts; columns left out are null."""
    names = [c.strip().split(" ")[0] for c in SESSION.split(",")]

    def build(rows, extra=""):
        wide = names + [c.split(" ")[0] for c in extra.split(", ") if c]
        return spark.createDataFrame([tuple(r.get(n) for n in wide) for r in rows], SESSION + (", " + extra if extra else ""))

    return build


@pytest.fixture(scope="session")
def zones(spark):
    return lambda rows: spark.createDataFrame([(s, None, None, z, None, None, None) for s, z in rows], SOURCES)
