import json
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def make_project(tmp_path):
    """Writes a project: its files, a tsconfig.json and, if given, its own configuration."""

    def make(files, config=None, options=None, include=("src",), name="project"):
        root = tmp_path / name
        written = dict(files)
        written["tsconfig.json"] = json.dumps({"include": list(include), "compilerOptions": {"declaration": True, **(options or {})}})
        if config is not None:
            written["arch.config.json"] = json.dumps(config)
        for path, text in written.items():
            (root / path).parent.mkdir(parents=True, exist_ok=True)
            (root / path).write_bytes(text.encode())
        return str(root)

    return make


#: A watering robot: garden -> robot -> util -> garden is a circle, all look at weather, which looks at nothing.
GARDEN = {
    "src/features/garden/index.ts": 'export * from "./beds";\nexport { water } from "./pump/water";\n',
    "src/features/garden/beds.ts": '// beds\nimport { rain } from "../weather/model/forecast";\n\nexport const beds = () => rain();\n',
    "src/features/garden/pump/water.ts": 'import { move } from "../../robot";\nexport const water = move;\n',
    "src/features/robot/index.ts": 'import type { Rain } from "~weather/model/forecast";\nimport { log } from "../../util/log";\nexport const move = (r: Rain) => log(r);\n',
    "src/features/weather/index.ts": 'export { rain } from "./model/forecast";\n',
    "src/features/weather/model/forecast.ts": "export type Rain = number;\nexport const rain = (): Rain => 3;\n",
    "src/util/log.ts": 'import { beds } from "@garden";\nexport const log = (x: unknown) => [x, beds];\n',
}


@pytest.fixture
def sample(make_project):
    aliases = {"baseUrl": "src/features", "paths": {"~weather/*": ["./weather/*"], "@garden": ["garden/index.ts"]}}
    return lambda config=None, name="project": make_project(GARDEN, config, aliases, name=name)
