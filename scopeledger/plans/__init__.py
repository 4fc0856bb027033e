"""Reports, KPIs, quality rules, allocation, forecasting and investment models."""
