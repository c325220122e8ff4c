import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from annoweave.session import build_session, clear_scratch, shared_folder  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", **{
        "spark.master": "local[8]", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    shared_folder(session)
    yield session
    clear_scratch(session)


@pytest.fixture
def rows():
    """The rows of a DataFrame as sorted tuples."""
    def collect(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.collect()), key=repr)
    return collect


def taxon(i, name, group="working boats", level=3, code=None):
    return {"id": i, "name": name, "supercategory": group, "level": level,
            "taxonomy_id": code or f"harbour-{i}"}


def dataset(images, annotations, **members):
    """A document about pictures of a harbour, with three kinds of things and three attributes."""
    return {"info": {"year": 1998, "version": "7", "date_created": "1998-11-30"},
            "licenses": [{"id": 1, "name": "open", "url": "l/open"}, {"id": 2, "name": "closed", "url": "l/closed"}],
            "categories": [taxon(1, "tug"), taxon(2, "buoy", "marks"), taxon(3, "ferry")],
            "attributes": [taxon(1, "rusty"), taxon(2, "moored"), taxon(3, "lit")],
            "images": images, "annotations": annotations, **members}


def image(i, license_id=1):
    return {"id": i, "width": 1024, "height": 768, "file_name": f"pier/{i}.png",
            "license": license_id, "time_captured": "noon", "original_url": f"h/{i}",
            "isstatic": False, "kaggle_id": f"tide {i}"}


def annotation(i, image_id, category_id=1, attribute_ids=(1,)):
    """One triangle: three points."""
    return {"id": i, "image_id": image_id, "category_id": category_id,
            "bbox": [11, 22.5, 33, 44], "area": 726.5, "iscrowd": 1,
            "attribute_ids": list(attribute_ids),
            "segmentation": [[11, 22.5, 44, 22.5, 27.5, 66.5]]}


@pytest.fixture
def document(tmp_path):
    """Write a document and give its path."""
    def write(content, name="data.json"):
        path = tmp_path / name
        path.write_text(json.dumps(content))
        return str(path)
    return write
