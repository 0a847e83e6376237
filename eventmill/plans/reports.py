"""Named SQL reports over registered views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Views: certificates(id, user_id, status), auth_user(id, username, date_joined, email, is_active),
# auth_userprofile(user_id, year_of_birth, gender, level_of_education), country_facts.
REPORTS = {
    "student_certs": """
        SELECT u.username, c.certs
        FROM (SELECT user_id, count(DISTINCT id) AS certs FROM certificates
              WHERE status = 'downloadable' GROUP BY user_id) c
        JOIN auth_user u ON u.id = c.user_id
        ORDER BY c.certs""",
    "basic_info": """
        SELECT u.username, u.date_joined, u.email, u.id, u.is_active,
               p.year_of_birth, p.gender, p.level_of_education
        FROM auth_user u JOIN auth_userprofile p ON u.id = p.user_id""",
    "some_users": "SELECT username, id FROM auth_user ORDER BY id LIMIT 10",
    "low_income_codes": """
        SELECT substring(Internet_country_code, 2, 2) AS code FROM country_facts
        WHERE GDP_per_capita_PPP < 3000 AND length(Internet_country_code) > 0""",
}


def run_report(spark: SparkSession, name: str, reports: dict[str, str] | None = None) -> DataFrame:
    return spark.sql((REPORTS if reports is None else reports)[name])


def save_reports(spark: SparkSession, folder: str, reports: dict[str, str] | None = None) -> list[str]:
    """Run every report and keep each result as `<name>.csv` below the folder."""
    reports = REPORTS if reports is None else reports
    for name in reports:
        run_report(spark, name, reports).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")
    return list(reports)
