from termloom.plans import registry


def test_versions_travel_without_their_texts(spark, folder):
    plan = registry.newest_version(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    window = next(i for i, line in enumerate(lines) if "Window" in line)
    # the hash is made below the window, so texts don't reach its shuffle
    assert any("sha2" in line for line in lines[window:]) and not any("sha2" in line for line in lines[:window])
