import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from newsloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", "tests", spark__sql__shuffle__partitions="4",
                            spark__ui__enabled="false", spark__driver__memory="6g")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


def article(i, **given):
    row = {"id": i, "article_id": f"a{i}", "title": f"title {i}", "content": f"content {i}", "summary": "", "url": f"http://x/{i}",
           "source": "s", "category": "c", "published_at": "2024-01-01T00:00:00", "author": "", "read_count": 0,
           "comment_count": 0, "tags": ["c"], "hotness_score": 0.0, "created_at": "2024-01-01T00:00:00", "updated_at": ""}
    return {**row, **given}


@pytest.fixture
def articles(spark):
    from newsloom.schemas import ARTICLE_SCHEMA

    def make(*rows):
        return spark.createDataFrame([article(**{"i": n + 1, **r}) if "i" not in r else article(**r) for n, r in enumerate(rows)], ARTICLE_SCHEMA)

    return make
