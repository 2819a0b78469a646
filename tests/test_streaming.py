from ridgeline.config import Settings
from ridgeline.pipeline import Warehouse
from ridgeline.streaming import drops
from tests.test_layers import HEADERS, order_lines


def test_new_files_rebuild_their_months(spark, tmp_path):
    folder = tmp_path / "drop"
    folder.mkdir()
    house = Warehouse(spark, Settings(excluded_partners=(), table_root=str(tmp_path / "tables")))
    schema = ", ".join(f"`{h}` string" for h in HEADERS)

    def feed(name, lines):
        (folder / name).write_text("\n".join([",".join(HEADERS), *[",".join(x) for x in lines]]), encoding="utf-8")
        drops.watch(spark, str(folder), schema, str(tmp_path / "state"), drops.importer(house)).awaitTermination()

    lines = list(order_lines())
    feed("a.csv", lines[:100])
    assert house.table("dwd_orders").count() == 100
    feed("b.csv", lines[90:])
    assert house.table("dwd_orders").count() == 182
    assert house.table("ads_partner_day").count() == 14
