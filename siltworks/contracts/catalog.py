"""The contracts that come with the package, by kind of source."""

from __future__ import annotations

from siltworks.contracts.model import Contract

# Column names and types the sources agree on.
PRODUCT_API = Contract.of(
    "ProductAPI", id="int", name="str", price="float", created_at="datetime", active="bool"
)
USER_API = Contract.of(
    "UserAPI", user_id="int", username="str", registered_at="datetime", is_active="bool"
)
PRODUCT_CSV = Contract.of(
    "ProductCSV", product_id="int", product_name="str", category="str?", price="float", available="bool"
)
SALE_CSV = Contract.of(
    "SaleCSV", sale_id="int", product_id="int", quantity="int", sale_date="datetime", total_value="float"
)
USER_CSV = Contract.of(
    "UserCSV", user_id="int", username="str", email="str", signup_date="datetime", is_active="bool"
)
CUSTOMER_DATABASE = Contract.of(
    "CustomerDatabase", customer_id="int", customer_name="str", registration_date="datetime", active="bool"
)
ARTICLE_WEB_SCRAPING = Contract.of(
    "ArticleWebScraping", article_id="int", title="str", published_at="datetime", url="str"
)

CATALOG = {
    c.name: c
    for c in (
        PRODUCT_API,
        USER_API,
        PRODUCT_CSV,
        SALE_CSV,
        USER_CSV,
        CUSTOMER_DATABASE,
        ARTICLE_WEB_SCRAPING,
    )
}
