"""Generated by tools/gen_kinds.py: canonical kind of each result column.

f fractional, i integer, b boolean, d date, t timestamp, s string, a<k> array, m<k> map."""

KINDS = {'account_aging': {'aging_category': 's',
                   'account_age_category': 's',
                   'account_count': 'i',
                   'total_balance': 'f',
                   'avg_balance': 'f',
                   'balance_percentage': 'f'},
 'account_opening_patterns': {'opening_year': 'i',
                              'opening_quarter': 'i',
                              'age_group': 's',
                              'customer_type': 's',
                              'account_type': 's',
                              'accounts_opened': 'i',
                              'avg_initial_balance': 'f',
                              'total_initial_deposits': 'f',
                              'growth_rate': 'f'},
 'behavior_segmentation': {'customer_id': 'i',
                           'first_name': 's',
                           'last_name': 's',
                           'email': 's',
                           'phone': 's',
                           'date_of_birth': 'd',
                           'address': 's',
                           'city': 's',
                           'state': 's',
                           'zip_code': 's',
                           'customer_since': 'd',
                           'customer_type': 's',
                           'transaction_frequency': 'i',
                           'avg_transaction_size': 'f',
                           'transaction_size_volatility': 'f',
                           'total_transaction_volume': 'f',
                           'product_usage_variety': 'i',
                           'total_balance': 'f',
                           'avg_balance': 'f',
                           'balance_volatility': 'f',
                           'number_of_accounts': 'i',
                           'total_credit_limit': 'f',
                           'total_credit_usage': 'f',
                           'avg_utilization_rate': 'f',
                           'segment_category': 's',
                           'segment_characteristics': 's'},
 'branch_migration': {'branch_id': 'i',
                      'next_branch': 'i',
                      'migration_count': 'i',
                      'avg_balance_at_migration': 'f',
                      'unique_customers': 'i',
                      'net_migration': 'i'},
 'branch_network': {'branch_id': 'i',
                    'branch_name': 's',
                    'branch_code': 's',
                    'address': 's',
                    'city': 's',
                    'state': 's',
                    'phone': 's',
                    'manager_id': 'i',
                    'total_accounts': 'i',
                    'total_deposits': 'f',
                    'total_transactions': 'i',
                    'transaction_volume': 'f',
                    'unique_customers': 'i',
                    'deposits_per_customer': 'f',
                    'transactions_per_customer': 'f',
                    'efficiency_score': 'f',
                    'optimization_recommendation': 's'},
 'branch_performance': {'branch_id': 'i',
                        'branch_name': 's',
                        'branch_code': 's',
                        'address': 's',
                        'city': 's',
                        'state': 's',
                        'phone': 's',
                        'manager_id': 'i',
                        'total_accounts': 'i',
                        'total_deposits': 'f',
                        'avg_account_balance': 'f',
                        'unique_customers': 'i',
                        'total_employees': 'i',
                        'avg_salary': 'f',
                        'diverse_positions': 'i',
                        'total_transactions': 'i',
                        'total_transaction_volume': 'f',
                        'avg_transaction_size': 'f',
                        'efficiency_ratio': 'f',
                        'deposit_growth_score': 'f',
                        'overall_performance_score': 'f'},
 'card_fraud': {'card_id': 'i',
                'card_transaction_id': 'i',
                'transaction_date': 't',
                'merchant_name': 's',
                'amount': 'f',
                'transaction_type': 's',
                'category': 's',
                'city': 's',
                'country': 's',
                'customer_id': 'i',
                'account_id': 'i',
                'card_number': 's',
                'card_type': 's',
                'credit_limit': 'f',
                'current_balance': 'f',
                'issue_date': 'd',
                'expiry_date': 'd',
                'status': 's',
                'time_since_last_tx': 'i',
                'amount_deviation': 'f',
                'unusual_location': 'i'},
 'cash_flow': {'customer_id': 'i',
               'INFLOW_avg_monthly_flow': 'f',
               'INFLOW_flow_volatility': 'f',
               'OUTFLOW_avg_monthly_flow': 'f',
               'OUTFLOW_flow_volatility': 'f',
               'OTHER_avg_monthly_flow': 'f',
               'OTHER_flow_volatility': 'f'},
 'cash_flow_net': {'customer_id': 'i',
                   'flow_type': 's',
                   'avg_monthly_flow': 'f',
                   'flow_volatility': 'f',
                   'total_flow': 'f',
                   'months_analyzed': 'i',
                   'net_flow_ratio': 'f'},
 'churn_features': {'customer_id': 'i',
                    'total_accounts': 'i',
                    'active_accounts': 'i',
                    'inactive_accounts': 'i',
                    'inactive_ratio': 'f',
                    'avg_balance': 'f',
                    'total_balance': 'f',
                    'min_days_inactive': 'i',
                    'max_days_inactive': 'i',
                    'churn_risk_score': 's'},
 'collateral_coverage': {'loan_type': 's',
                         'coverage_adequacy': 's',
                         'loan_count': 'i',
                         'total_loan_amount': 'f',
                         'avg_coverage_ratio': 'f',
                         'min_coverage_ratio': 'f',
                         'avg_risk_adjusted_coverage': 'f'},
 'compliance_aml': {'customer_id': 'i',
                    'suspicious_indicator': 's',
                    'alert_count': 'i',
                    'total_suspicious_amount': 'f',
                    'suspicious_date_count': 'i'},
 'compliance_aml_date_pages': {'customer_id': 'i',
                               'suspicious_indicator': 's',
                               'page': 'i',
                               'suspicious_dates': 'at'},
 'compliance_aml_dates': {'customer_id': 'i', 'suspicious_indicator': 's', 'transaction_date': 't'},
 'compliance_aml_dense': {'customer_id': 'i',
                          'suspicious_indicator': 's',
                          'alert_count': 'i',
                          'total_suspicious_amount': 'f',
                          'suspicious_date_count': 'i'},
 'compliance_credit': {'compliance_issue': 's',
                       'non_compliant_cards': 'i',
                       'avg_balance': 'f',
                       'avg_limit': 'f'},
 'compliance_kyc': {'kyc_risk_indicator': 's', 'non_compliant_customers': 'i'},
 'compliance_risk': {'aml_alert_customers': 'i',
                     'kyc_non_compliant': 'i',
                     'credit_non_compliant': 'i',
                     'overall_compliance_risk': 's'},
 'concentration_risk': {'customer_type': 's',
                        'state': 's',
                        'customer_count': 'i',
                        'total_exposure': 'f',
                        'avg_exposure': 'f',
                        'exposure_percentage': 'f',
                        'concentration_risk': 's'},
 'counterparty_risk': {'customer_id': 'i',
                       'first_name': 's',
                       'last_name': 's',
                       'email': 's',
                       'phone': 's',
                       'date_of_birth': 'd',
                       'address': 's',
                       'city': 's',
                       'state': 's',
                       'zip_code': 's',
                       'customer_since': 'd',
                       'customer_type': 's',
                       'business_partner_count': 'i',
                       'total_business_allocation': 'f',
                       'total_borrowing': 'f',
                       'exposure_percentile': 'f',
                       'is_large_exposure': 'b',
                       'counterparty_risk_score': 'f',
                       'risk_category': 's'},
 'credit_risk_portfolio': {'customer_type': 's',
                           'loan_type': 's',
                           'credit_facilities': 'i',
                           'total_exposure': 'f',
                           'avg_interest_rate': 'f',
                           'p95_exposure': 'f',
                           'risk_adjusted_return': 'f',
                           'portfolio_quality': 's'},
 'credit_utilization': {'customer_id': 'i',
                        'card_id': 'i',
                        'account_id': 'i',
                        'card_number': 's',
                        'card_type': 's',
                        'credit_limit': 'f',
                        'current_balance': 'f',
                        'issue_date': 'd',
                        'expiry_date': 'd',
                        'status': 's',
                        'first_name': 's',
                        'last_name': 's',
                        'email': 's',
                        'phone': 's',
                        'date_of_birth': 'd',
                        'address': 's',
                        'city': 's',
                        'state': 's',
                        'zip_code': 's',
                        'customer_since': 'd',
                        'customer_type': 's',
                        'utilization_rate': 'f',
                        'avg_monthly_utilization': 'f',
                        'utilization_volatility': 'f',
                        'peak_utilization': 'f',
                        'utilization_category': 's',
                        'utilization_trend': 's'},
 'cross_sell': {'customer_id': 'i',
                'first_name': 's',
                'last_name': 's',
                'email': 's',
                'phone': 's',
                'date_of_birth': 'd',
                'address': 's',
                'city': 's',
                'state': 's',
                'zip_code': 's',
                'customer_since': 'd',
                'customer_type': 's',
                'account_count': 'i',
                'active_loan_count': 'i',
                'active_card_count': 'i',
                'missing_products': 's',
                'opportunity_score': 'f',
                'priority_level': 's'},
 'customer_360': {'customer_id': 'i',
                  'first_name': 's',
                  'last_name': 's',
                  'email': 's',
                  'phone': 's',
                  'date_of_birth': 'd',
                  'address': 's',
                  'city': 's',
                  'state': 's',
                  'zip_code': 's',
                  'customer_since': 'd',
                  'customer_type': 's',
                  'active_accounts': 'i',
                  'total_deposits': 'f',
                  'avg_account_balance': 'f',
                  'account_types': 'i',
                  'lifetime_transactions': 'i',
                  'avg_transaction_amount': 'f',
                  'lifetime_transaction_volume': 'f',
                  'last_transaction_date': 't',
                  'active_credit_products': 'i',
                  'total_credit_exposure': 'f',
                  'credit_product_types': 'i',
                  'beneficiary_relationships': 'i',
                  'relationship_types': 'i',
                  'days_since_last_transaction': 'i',
                  'customer_value_tier': 's',
                  'relationship_strength': 'f',
                  'next_best_action': 's'},
 'customer_lifetime_value': {'customer_id': 'i',
                             'first_name': 's',
                             'last_name': 's',
                             'email': 's',
                             'phone': 's',
                             'date_of_birth': 'd',
                             'address': 's',
                             'city': 's',
                             'state': 's',
                             'zip_code': 's',
                             'customer_since': 'd',
                             'customer_type': 's',
                             'total_loan_revenue': 'f',
                             'total_card_revenue': 'f',
                             'transaction_fees': 'f',
                             'total_lifetime_value': 'f',
                             'customer_value_tier': 's'},
 'customer_migration': {'branch_id': 'i',
                        'next_branch': 'i',
                        'migration_count': 'i',
                        'avg_balance_at_migration': 'f',
                        'unique_customers': 'i',
                        'net_migration': 'i',
                        'account_type': 's',
                        'next_product': 's',
                        'product_switch_count': 'i',
                        'avg_time_to_switch': 'f'},
 'customer_portfolio': {'customer_id': 'i',
                        'first_name': 's',
                        'last_name': 's',
                        'email': 's',
                        'phone': 's',
                        'date_of_birth': 'd',
                        'address': 's',
                        'city': 's',
                        'state': 's',
                        'zip_code': 's',
                        'customer_since': 'd',
                        'customer_type': 's',
                        'CHECKING': 'f',
                        'SAVINGS': 'f',
                        'BUSINESS': 'f',
                        'LOAN': 'f',
                        'active_loans': 'i',
                        'total_loan_amount': 'f',
                        'avg_interest_rate': 'f',
                        'active_cards': 'i',
                        'total_credit_limit': 'f',
                        'total_card_balance': 'f',
                        'total_assets': 'f',
                        'total_liabilities': 'f',
                        'net_worth': 'f',
                        'leverage_ratio': 'f',
                        'balances_by_type': 'mf'},
 'customer_portfolio_types': {'customer_id': 'i', 'account_type': 's', 'balance': 'f'},
 'demographic_targeting': {'age_group': 's',
                           'customer_type': 's',
                           'customer_count': 'i',
                           'avg_balance': 'f',
                           'total_balance': 'f',
                           'median_balance': 'f',
                           'loan_count': 'i',
                           'loan_penetration_rate': 'f',
                           'targeting_opportunity': 's'},
 'deposit_sensitivity': {'deposit_category': 's',
                         'total_deposits': 'f',
                         'account_count': 'i',
                         'avg_balance': 'f',
                         'deposit_stability_score': 'f'},
 'digital_engagement': {'customer_id': 'i',
                        'total_transactions': 'i',
                        'off_hours_transactions': 'i',
                        'weekend_transactions': 'i',
                        'avg_transaction_size': 'f',
                        'digital_transactions': 'i',
                        'branch_transactions': 'i',
                        'digital_engagement_ratio': 'f',
                        'digital_adoption_level': 's',
                        'migration_opportunity': 's'},
 'early_warning': {'account_id': 'i',
                   'loan_id': 'i',
                   'customer_id': 'i',
                   'loan_type': 's',
                   'loan_amount': 'f',
                   'interest_rate': 'f',
                   'term_months': 'i',
                   'start_date': 'd',
                   'end_date': 'd',
                   'status': 's',
                   'approved_by': 'i',
                   'avg_payment_delay': 'f',
                   'payment_delay_volatility': 'f',
                   'delayed_payment_count': 'i',
                   'total_payments': 'i',
                   'delinquency_trend': 'f',
                   'account_customer_id': 'i',
                   'account_number': 's',
                   'account_type': 's',
                   'balance': 'f',
                   'open_date': 'd',
                   'close_date': 'd',
                   'account_status': 's',
                   'branch_id': 'i',
                   'avg_volume_change': 'f',
                   'volume_change_volatility': 'f',
                   'worst_volume_decline': 'f',
                   'warning_score': 'f',
                   'warning_level': 's',
                   'recommended_action': 's'},
 'employee_performance': {'branch_id': 'i',
                          'employee_id': 'i',
                          'first_name': 's',
                          'last_name': 's',
                          'position': 's',
                          'email': 's',
                          'phone': 's',
                          'hire_date': 'd',
                          'salary': 'f',
                          'manager_id': 'i',
                          'approved_by': 'i',
                          'loans_approved': 'i',
                          'total_loan_volume': 'f',
                          'avg_loan_size': 'f',
                          'accounts_in_branch': 'i',
                          'branch_name': 's',
                          'branch_code': 's',
                          'address': 's',
                          'city': 's',
                          'state': 's',
                          'branch_phone': 's',
                          'branch_manager_id': 'i',
                          'performance_score': 'f',
                          'efficiency_ratio': 'f',
                          'performance_tier': 's'},
 'employee_productivity': {'branch_id': 'i',
                           'employee_id': 'i',
                           'first_name': 's',
                           'last_name': 's',
                           'position': 's',
                           'email': 's',
                           'phone': 's',
                           'hire_date': 'd',
                           'salary': 'f',
                           'manager_id': 'i',
                           'approved_by': 'i',
                           'loans_approved': 'i',
                           'total_loan_volume': 'f',
                           'branch_accounts': 'i',
                           'tenure_months': 'f',
                           'productivity_score': 'f',
                           'position_percentile': 'f',
                           'performance_category': 's',
                           'salary_to_productivity_ratio': 'f'},
 'executive_summary': {'total_customers': 'i',
                       'business_customers': 'i',
                       'individual_customers': 'i',
                       'total_accounts': 'i',
                       'total_deposits': 'f',
                       'avg_account_balance': 'f',
                       'active_loans': 'i',
                       'total_loan_portfolio': 'f',
                       'total_transactions': 'i',
                       'total_transaction_volume': 'f'},
 'fee_income': {'customer_type': 's',
                'account_type': 's',
                'fee_category': 's',
                'transaction_count': 'i',
                'total_fee_income': 'f',
                'avg_fee_per_transaction': 'f',
                'total_transaction_volume': 'f',
                'fee_to_volume_ratio': 'f',
                'optimization_opportunity': 's'},
 'geographic_expansion': {'state': 's',
                          'city': 's',
                          'current_customers': 'i',
                          'total_deposits': 'f',
                          'avg_balance_per_customer': 'f',
                          'branch_count': 'i',
                          'customers_per_branch': 'f',
                          'deposits_per_branch': 'f',
                          'market_saturation': 's',
                          'expansion_priority': 's',
                          'potential_new_customers': 'i'},
 'interest_rate_risk': {'loan_type': 's',
                        'loan_count': 'i',
                        'total_loan_amount': 'f',
                        'avg_interest_rate': 'f',
                        'total_impact_1pct': 'f',
                        'total_impact_2pct': 'f',
                        'median_rate': 'f',
                        'portfolio_sensitivity': 'f',
                        'risk_category': 's'},
 'liquidity': {'total_liquid_assets': 'f',
               'projected_outflows_30d': 'f',
               'total_loan_commitments': 'f',
               'liquidity_ratio': 'f',
               'coverage_ratio': 'f',
               'liquidity_status': 's'},
 'loan_default_features': {'customer_id': 'i',
                           'loan_id': 'i',
                           'account_id': 'i',
                           'loan_type': 's',
                           'loan_amount': 'f',
                           'interest_rate': 'f',
                           'term_months': 'i',
                           'start_date': 'd',
                           'end_date': 'd',
                           'status': 's',
                           'approved_by': 'i',
                           'total_overdue_payments': 'i',
                           'avg_days_delayed': 'f',
                           'max_days_delayed': 'i',
                           'total_amount_paid': 'f',
                           'total_amount_due': 'f',
                           'payment_completion_ratio': 'f',
                           'first_name': 's',
                           'last_name': 's',
                           'email': 's',
                           'phone': 's',
                           'date_of_birth': 'd',
                           'address': 's',
                           'city': 's',
                           'state': 's',
                           'zip_code': 's',
                           'customer_since': 'd',
                           'customer_type': 's',
                           'total_balance': 'f',
                           'avg_balance': 'f',
                           'total_accounts': 'i',
                           'loan_to_balance_ratio': 'f',
                           'default_risk_score': 'f',
                           'default_probability_category': 's'},
 'loan_risk': {'customer_id': 'i',
               'account_id': 'i',
               'loan_id': 'i',
               'loan_type': 's',
               'loan_amount': 'f',
               'interest_rate': 'f',
               'term_months': 'i',
               'start_date': 'd',
               'end_date': 'd',
               'status': 's',
               'approved_by': 'i',
               'total_payments': 'i',
               'overdue_payments': 'i',
               'payment_ratio': 'f',
               'max_days_late': 'i',
               'account_number': 's',
               'account_type': 's',
               'balance': 'f',
               'open_date': 'd',
               'close_date': 'd',
               'account_status': 's',
               'branch_id': 'i',
               'delinquency_rate': 'f',
               'risk_score': 's'},
 'market_position': {'state': 's',
                     'customer_base': 'i',
                     'total_deposits': 'f',
                     'avg_balance': 'f',
                     'market_share_ranking': 'f'},
 'market_risk': {'duration_category': 's',
                 'loan_type': 's',
                 'loan_count': 'i',
                 'total_exposure': 'f',
                 'avg_interest_rate': 'f',
                 'total_impact_1pct': 'f',
                 'sensitivity_ratio': 'f',
                 'market_risk_level': 's',
                 'avg_deposit_stability': 'f'},
 'non_performing_assets': {'npa_category': 's',
                           'loan_type': 's',
                           'npa_count': 'i',
                           'npa_amount': 'f',
                           'avg_days_overdue': 'f'},
 'operational_efficiency': {'branch_id': 'i',
                            'branch_name': 's',
                            'branch_code': 's',
                            'address': 's',
                            'city': 's',
                            'state': 's',
                            'phone': 's',
                            'manager_id': 'i',
                            'accounts_managed': 'i',
                            'deposits_managed': 'f',
                            'transactions_processed': 'i',
                            'staff_count': 'i',
                            'avg_salary': 'f',
                            'accounts_per_staff': 'f',
                            'transactions_per_staff': 'f',
                            'deposits_per_staff': 'f',
                            'cost_per_transaction': 'f',
                            'efficiency_score': 'f',
                            'efficiency_quartile': 'i',
                            'improvement_recommendation': 's'},
 'operational_risk': {'branch_id': 'i',
                      'total_transactions': 'i',
                      'high_value_transactions': 'i',
                      'weekend_transactions': 'i',
                      'avg_transaction_size': 'f',
                      'operational_risk_score': 'f',
                      'risk_category': 's'},
 'product_benchmark': {'account_type': 's',
                       'current_accounts': 'i',
                       'current_balance': 'f',
                       'current_avg_balance': 'f',
                       'target_accounts': 'i',
                       'target_balance': 'i',
                       'accounts_target_achievement': 'f',
                       'balance_target_achievement': 'f',
                       'overall_performance_score': 'f',
                       'performance_status': 's'},
 'product_cards': {'card_type': 's',
                   'total_cards': 'i',
                   'total_credit_limit': 'f',
                   'avg_balance': 'f',
                   'avg_credit_limit': 'f'},
 'product_concentration': {'account_type': 's',
                           'account_count': 'i',
                           'total_balance': 'f',
                           'avg_account_age': 'f',
                           'portfolio_concentration': 'f'},
 'product_dashboard': {'account_type': 's', 'accounts': 'i', 'deposits': 'f', 'avg_balance': 'f'},
 'product_loans': {'loan_type': 's',
                   'total_loans': 'i',
                   'total_loan_amount': 'f',
                   'avg_loan_amount': 'f',
                   'avg_interest_rate': 'f'},
 'product_migration': {'account_type': 's',
                       'next_product': 's',
                       'product_switch_count': 'i',
                       'avg_time_to_switch': 'f'},
 'product_portfolio': {'account_type': 's',
                       'total_accounts': 'i',
                       'total_balance': 'f',
                       'avg_balance': 'f',
                       'unique_customers': 'i',
                       'avg_account_age_days': 'f',
                       'total_transactions': 'i',
                       'total_transaction_volume': 'f',
                       'avg_transaction_amount': 'f',
                       'profitability_score': 'f',
                       'product_performance_tier': 's'},
 'recovery_rate': {'loan_type': 's',
                   'defaulted_loans_count': 'i',
                   'avg_recovery_rate': 'f',
                   'avg_recovery_time': 'f',
                   'total_defaulted_amount': 'f',
                   'total_recovered_amount': 'f',
                   'median_recovery_rate': 'f',
                   'recovery_efficiency': 'f',
                   'recovery_performance': 's'},
 'regional_performance': {'branch_id': 'i',
                          'branch_name': 's',
                          'branch_code': 's',
                          'address': 's',
                          'city': 's',
                          'state': 's',
                          'phone': 's',
                          'manager_id': 'i',
                          'accounts': 'i',
                          'deposits': 'f',
                          'employees': 'i',
                          'avg_salary': 'f',
                          'deposits_per_employee': 'f',
                          'efficiency_ratio': 'f'},
 'regulatory_alert_pages': {'customer_id': 'i',
                            'compliance_alert_level': 's',
                            'page': 'i',
                            'alert_transactions': 'ai'},
 'regulatory_alerts': {'account_id': 'i',
                       'transaction_id': 'i',
                       'amount': 'f',
                       'compliance_alert_level': 's',
                       'customer_id': 'i'},
 'regulatory_compliance': {'customer_id': 'i',
                           'compliance_alert_level': 's',
                           'alert_count': 'i',
                           'total_alert_amount': 'f'},
 'regulatory_compliance_dense': {'customer_id': 'i',
                                 'compliance_alert_level': 's',
                                 'alert_count': 'i',
                                 'total_alert_amount': 'f'},
 'relationship_network': {'customer_id': 'i',
                          'first_name': 's',
                          'last_name': 's',
                          'email': 's',
                          'phone': 's',
                          'date_of_birth': 'd',
                          'address': 's',
                          'city': 's',
                          'state': 's',
                          'zip_code': 's',
                          'customer_since': 'd',
                          'customer_type': 's',
                          'connected_accounts': 'i',
                          'total_network_balance': 'f',
                          'unique_connections': 'i',
                          'SPOUSE': 'i',
                          'CHILD': 'i',
                          'PARENT': 'i',
                          'BUSINESS_PARTNER': 'i',
                          'network_influence': 'f',
                          'relationship_diversity': 's',
                          'beneficiaries_by_relationship': 'mi'},
 'relationship_types': {'customer_id': 'i', 'relationship': 's', 'beneficiaries': 'i'},
 'reporting_framework': {'section': 's', 'key': 's', 'measure': 's', 'value': 'f'},
 'risk_adjusted_returns': {'loan_type': 's',
                           'total_annual_revenue': 'f',
                           'avg_overdue_frequency': 'f',
                           'avg_interest_rate': 'f',
                           'risk_adjustment_factor': 'f',
                           'risk_adjusted_revenue': 'f',
                           'return_per_risk_unit': 'f',
                           'performance_ranking': 's'},
 'risk_overview': {'defaulted_loans': 'i',
                   'defaulted_amount': 'f',
                   'total_loans': 'i',
                   'total_loan_amount': 'f',
                   'default_rate': 'f',
                   'default_ratio': 'f'},
 'satisfaction': {'customer_id': 'i',
                  'first_name': 's',
                  'last_name': 's',
                  'email': 's',
                  'phone': 's',
                  'date_of_birth': 'd',
                  'address': 's',
                  'city': 's',
                  'state': 's',
                  'zip_code': 's',
                  'customer_since': 'd',
                  'customer_type': 's',
                  'total_transactions': 'i',
                  'avg_transaction_size': 'f',
                  'product_usage_variety': 'i',
                  'business_hours_usage_ratio': 'f',
                  'active_days': 'i',
                  'total_products': 'i',
                  'total_relationship_balance': 'f',
                  'avg_relationship_length': 'f',
                  'satisfaction_score': 'f',
                  'satisfaction_level': 's',
                  'retention_risk': 's'},
 'seasonal_patterns': {'transaction_year': 'i',
                       'transaction_quarter': 'i',
                       'transaction_month': 'i',
                       'account_type': 's',
                       'transaction_count': 'i',
                       'transaction_volume': 'f',
                       'avg_transaction_size': 'f',
                       'seasonal_index': 'f',
                       'seasonal_pattern': 's',
                       'year_over_year_growth': 'f'},
 'service_levels': {'account_type': 's',
                    'transaction_type': 's',
                    'p95_processing_time': 'f',
                    'avg_processing_time': 'f',
                    'transaction_count': 'i',
                    'service_level_agreement': 's',
                    'performance_rating': 's'},
 'service_levels_dense': {'account_type': 's',
                          'transaction_type': 's',
                          'p95_processing_time': 'f',
                          'avg_processing_time': 'f',
                          'transaction_count': 'i',
                          'service_level_agreement': 's',
                          'performance_rating': 's'},
 'single_product_customers': {'state': 's', 'customer_type': 's', 'cross_sell_opportunities': 'i'},
 'strategic_planning': {'state': 's',
                        'customer_base': 'i',
                        'total_deposits': 'f',
                        'avg_balance': 'f',
                        'market_share_ranking': 'f',
                        'customer_type': 's',
                        'cross_sell_opportunities': 'i',
                        'account_type': 's',
                        'account_count': 'i',
                        'total_balance': 'f',
                        'avg_account_age': 'f',
                        'portfolio_concentration': 'f',
                        'strategic_recommendation': 's'},
 'stress_testing': {'loan_type': 's',
                    'portfolio_count': 'i',
                    'total_exposure': 'f',
                    'base_expected_loss': 'f',
                    'stress_1_expected_loss': 'f',
                    'stress_2_expected_loss': 'f',
                    'stress_3_expected_loss': 'f',
                    'loss_increase_scenario_1': 'f',
                    'loss_increase_scenario_2': 'f',
                    'loss_increase_scenario_3': 'f',
                    'capital_adequacy_stress_1': 's',
                    'capital_adequacy_stress_2': 's'},
 'transaction_anomalies': {'transaction_id': 'i',
                           'account_id': 'i',
                           'amount': 'f',
                           'transaction_type': 's',
                           'z_score': 'f',
                           'balance': 'f',
                           'account_avg_amount': 'f'},
 'transaction_anomalies_dense': {'transaction_id': 'i',
                                 'account_id': 'i',
                                 'amount': 'f',
                                 'transaction_type': 's',
                                 'z_score': 'f',
                                 'balance': 'f',
                                 'account_avg_amount': 'f'},
 'transaction_segmentation': {'customer_id': 'i',
                              'total_transactions': 'i',
                              'avg_transaction_amount': 'f',
                              'std_transaction_amount': 'f',
                              'total_transaction_volume': 'f',
                              'unique_transaction_types': 'i',
                              'total_accounts': 'i',
                              'total_balance': 'f',
                              'avg_balance': 'f',
                              'transaction_frequency_segment': 's',
                              'balance_segment': 's'},
 'transaction_velocity': {'account_id': 'i',
                          'transaction_date_only': 'd',
                          'daily_transaction_count': 'i',
                          'daily_transaction_amount': 'f',
                          'avg_transaction_amount': 'f',
                          'unique_transaction_types': 'i',
                          'rolling_avg_7d': 'f',
                          'velocity_alert': 's'},
 'transaction_velocity_dense': {'account_id': 'i',
                                'transaction_date_only': 'd',
                                'daily_transaction_count': 'i',
                                'daily_transaction_amount': 'f',
                                'avg_transaction_amount': 'f',
                                'unique_transaction_types': 'i',
                                'rolling_avg_7d': 'f',
                                'velocity_alert': 's'}}
