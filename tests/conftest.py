import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from twinsift.session import build_session

    session = build_session(4, "tests", **{"spark.sql.shuffle.partitions": "2", "spark.sql.adaptive.enabled": "false", "spark.sql.codegen.wholeStage": "false", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session


ORDER_TOTAL = """function orderTotal(items, taxRate) {
  let total = 0;
  for (const item of items) {
    if (item.price < 0) {
      throw new Error("negative price");
    }
    total += item.price * item.count;
  }
  const tax = total * taxRate;
  const gross = total + tax;
  return Math.round(gross * 100) / 100;
}
"""


def inventory(spark, texts: dict[str, str], config=None):
    """Files of a fixture as the audit's inventory."""
    from twinsift.config import Config
    from twinsift.sources.project import as_inventory

    rows = [(i, p, t) for i, (p, t) in enumerate(texts.items())]
    return as_inventory(spark.createDataFrame(rows, "ord bigint, path string, text string"), config or Config())
