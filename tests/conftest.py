import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tabproof.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        **{
            "spark.master": "local[4]",
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


CLIENTS = 30


def client_rows():
    """What clients did: kinds with odd spelling, two losses and a zero, tokens with gaps and a copy, two unset days."""
    rows = [
        {
            "kind": ("view", "click", "cart", "buy")[i % 4],
            "value": 3.75 * (i % 10) + 1.5,
            "client_id": i,
            "token": f"{i * 7919 % 10007:05d}x",
            "seen": str(dt.date(2021, 1, 5) + dt.timedelta(days=3 * i)),
            "repeat": str(i % 5 == 0).lower(),
        }
        for i in range(CLIENTS)
    ]
    rows[22]["kind"], rows[7]["kind"], rows[21]["kind"] = "VIEW", "  ", " cart"
    rows[6]["value"] = rows[19]["value"] = -4.25
    rows[13]["value"] = 0
    rows[11]["token"] = rows[12]["token"] = ""
    rows[24]["token"], rows[18]["token"] = rows[3]["token"], "ζήτα18"
    rows[2]["seen"] = rows[9]["seen"] = "1970-01-01"
    rows[28]["seen"] = "2093-05-06"
    return rows


SECRETS = ["07919", "05831", "view", "VIEW", "click", "ζήτα", "η"]


def csv_text(rows):
    return "\n".join([",".join(rows[0]), *(",".join(map(str, r.values())) for r in rows)]) + "\n"


@pytest.fixture(scope="session")
def folder(tmp_path_factory):
    """Clients; twelve deals, the last without items; items, two of them of unknown deals; keys written with zeros."""
    root = tmp_path_factory.mktemp("sources")
    (root / "clients.csv").write_text(csv_text(client_rows()), encoding="utf-8")
    deals = [{"deal_id": i, "client_id": i * 5 % CLIENTS, "total": f"{i * 10}.25"} for i in range(1, 13)]
    items = [{"item_id": i, "deal_id": i * 7 % 11 + 1, "pieces": i % 4 + 1} for i in range(1, 21)]
    items += [{"item_id": 21, "deal_id": 77, "pieces": 2}, {"item_id": 22, "deal_id": 78, "pieces": 1}]
    coded = [{"item_id": i + 1, "deal_id": f"{k:04d}"} for i, k in enumerate((3, 7, 42, 5))]
    for name, rows in (("deals", deals), ("items", items), ("coded", coded)):
        (root / f"{name}.csv").write_text(csv_text(rows))
    return root


@pytest.fixture(scope="session")
def catalog(spark, folder):
    from tabproof.sources.catalog import Source, load_catalog

    return load_catalog(spark, [Source(str(folder / f"{n}.csv")) for n in ("clients", "deals", "items", "coded")])
