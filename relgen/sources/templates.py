"""Schemas to start from."""

from __future__ import annotations

TEMPLATES = {
    "ecommerce": """CREATE TYPE order_state AS ENUM ('open', 'paid', 'shipped', 'returned');
CREATE TABLE customers (id SERIAL PRIMARY KEY, email VARCHAR(120) NOT NULL UNIQUE, full_name TEXT, city TEXT, created_at TIMESTAMP NOT NULL);
CREATE TABLE categories (id SERIAL PRIMARY KEY, name TEXT NOT NULL, parent_id INT REFERENCES categories(id));
CREATE TABLE products (id SERIAL PRIMARY KEY, title VARCHAR(80) NOT NULL, price NUMERIC(10,2) NOT NULL, category_id INT REFERENCES categories(id));
CREATE TABLE orders (id SERIAL PRIMARY KEY, customer_id INT NOT NULL REFERENCES customers(id) ON DELETE CASCADE, state order_state NOT NULL, created_at TIMESTAMP NOT NULL);
CREATE TABLE order_items (order_id INT REFERENCES orders(id) ON DELETE CASCADE, product_id INT REFERENCES products(id), quantity SMALLINT NOT NULL, PRIMARY KEY (order_id, product_id));
""",
    "blog": """CREATE TABLE authors (id SERIAL PRIMARY KEY, email VARCHAR(120) NOT NULL UNIQUE, first_name TEXT, last_name TEXT);
CREATE TABLE posts (id SERIAL PRIMARY KEY, author_id INT NOT NULL REFERENCES authors(id), title VARCHAR(80) NOT NULL, slug VARCHAR(80) NOT NULL UNIQUE, created_at TIMESTAMP, updated_at TIMESTAMP, deleted_at TIMESTAMP);
CREATE TABLE tags (id SERIAL PRIMARY KEY, name VARCHAR(40) NOT NULL UNIQUE);
CREATE TABLE post_tags (post_id INT REFERENCES posts(id), tag_id INT REFERENCES tags(id), PRIMARY KEY (post_id, tag_id));
CREATE TABLE comments (id SERIAL PRIMARY KEY, post_id INT NOT NULL REFERENCES posts(id) ON DELETE CASCADE, parent_id INT REFERENCES comments(id), description TEXT);
""",
    "saas": """CREATE TYPE plan AS ENUM ('free', 'team', 'company');
CREATE TABLE tenants (id UUID PRIMARY KEY, name TEXT NOT NULL, plan plan NOT NULL, created_at TIMESTAMP NOT NULL);
CREATE TABLE members (id UUID PRIMARY KEY, tenant_id UUID NOT NULL REFERENCES tenants(id) ON DELETE CASCADE, email VARCHAR(120) NOT NULL UNIQUE, phone TEXT);
CREATE TABLE invoices (id BIGSERIAL PRIMARY KEY, tenant_id UUID NOT NULL REFERENCES tenants(id), amount NUMERIC(12,2) NOT NULL, due DATE);
CREATE TABLE audit_log (id BIGSERIAL PRIMARY KEY, member_id UUID REFERENCES members(id), ip INET, details JSONB, created_at TIMESTAMP NOT NULL);
""",
}
