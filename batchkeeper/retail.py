"""The retail contract: customers, products, daily orders and daily click events."""

from __future__ import annotations

from batchkeeper.contract import Contract

# Value domains of the retail feeds.
REGIONS = ("NA", "EU", "APAC", "LATAM", "MEA")
CATEGORIES = ("electronics", "home", "apparel", "grocery", "sports", "toys", "beauty")
EVENT_TYPES = ("page_view", "add_to_cart", "checkout_start", "checkout_complete", "search")
EVENT_WEIGHTS = (50, 20, 15, 10, 5)
ORDER_STATUSES = ("placed", "shipped", "delivered", "cancelled", "refunded")
ORDER_WEIGHTS = (50, 25, 15, 7, 3)

# The remediation policy by fault category.
POLICY = {
    "duplicate_ingestion": "auto_fix",
    "volume_anomaly_spike": "auto_fix",
    "schema_drift": "escalate",
    "volume_anomaly_drop": "escalate",
    "null_spike": "escalate",
    "referential_break": "escalate",
    "staleness": "escalate",
}


def retail_contract(
    customers: int = 500,
    products: int = 60,
    orders_per_day: int = 300,
    events_per_day: int = 1200,
) -> Contract:
    """The contract with row bounds recomputed from nominal volumes.

    Tolerances around nominal: customers 4 %, products 5 rows in 60, orders 20 %,
    events 25 %.
    """

    def around(nominal: int, share: float) -> dict[str, int]:
        return {"min": round(nominal * (1 - share)), "max": round(nominal * (1 + share))}

    return Contract.from_dict(
        {
            "datasets": {
                "customers": {
                    "source": "csv",
                    "path_pattern": "customers.csv",
                    "primary_key": "customer_id",
                    "expected_row_count": around(customers, 0.04),
                    "schema": {
                        "customer_id": "string",
                        "name": "string",
                        "email": "string",
                        "region": "string",
                        "signup_date": "date",
                    },
                    "accepted_values": {"region": REGIONS},
                },
                "products": {
                    "source": "csv",
                    "path_pattern": "products.csv",
                    "primary_key": "product_id",
                    "expected_row_count": around(products, 5 / 60),
                    "schema": {
                        "product_id": "string",
                        "name": "string",
                        "category": "string",
                        "price": "float",
                    },
                    "accepted_values": {"category": CATEGORIES},
                },
                "orders": {
                    "source": "csv",
                    "path_pattern": "orders/orders_{date}.csv",
                    "primary_key": "order_id",
                    "foreign_keys": {
                        "customer_id": "customers.customer_id",
                        "product_id": "products.product_id",
                    },
                    "expected_row_count_per_batch": around(orders_per_day, 0.20),
                    "schema": {
                        "order_id": "string",
                        "customer_id": "string",
                        "product_id": "string",
                        "order_ts": "timestamp",
                        "quantity": "integer",
                        "order_total": "float",
                        "status": "string",
                    },
                    "null_tolerance": {"order_total": 0.02, "customer_id": 0.0},
                    "freshness_sla": {"max_delay_hours": 26},
                    "accepted_values": {"status": ORDER_STATUSES},
                },
                "events": {
                    "source": "mock_api",
                    "path_pattern": "events/events_{date}.jsonl",
                    "primary_key": "event_id",
                    "foreign_keys": {"customer_id": "customers.customer_id"},
                    "expected_row_count_per_batch": around(events_per_day, 0.25),
                    "schema": {
                        "event_id": "string",
                        "customer_id": "string",
                        "event_type": "string",
                        "session_id": "string",
                        "event_ts": "timestamp",
                    },
                    "freshness_sla": {"max_delay_hours": 6},
                    "accepted_values": {"event_type": EVENT_TYPES},
                },
            },
            "warehouse": {
                "tables": {
                    "customers": "dim_customers",
                    "products": "dim_products",
                    "orders": "fct_orders",
                    "events": "fct_events",
                }
            },
            "remediation_policy": POLICY,
        }
    )
