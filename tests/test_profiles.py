from strandline.plans import relational_queries as Q


def test_buckets_of_all_profiles(spark, data):
    b = spark.read.parquet(f"{data}/read_signatures.parquet").filter("bucket_key IS NOT NULL").select("profile_id", "h", "bucket_key", "read_id").distinct()
    limits = {r.profile_id: r.max_results_per_map for r in spark.read.parquet(f"{data}/run_options.parquet").collect()}
    sizes = b.groupBy("profile_id", "h", "bucket_key").count().collect()
    assert len({r.profile_id for r in sizes}) > 1 and any(r["count"] > limits[r.profile_id] for r in sizes)
    assert Q.j8_all_truncated_buckets(spark, data).count() == sum(min(r["count"], limits[r.profile_id]) for r in sizes)
    assert Q.j8_all_dropped_buckets(spark, data).count() == sum(r["count"] for r in sizes if r["count"] <= limits[r.profile_id])
    assert Q.j4_all_shared_buckets(spark, data).count() == sum(r["count"] for r in sizes if r["count"] > 1)
