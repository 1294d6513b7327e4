"""The engine over star-schema tables: parts as titles, orders and line items as holdings and items, and so on."""
